"""License detection by ordered signature rules.

A rule is a label, a priority and a pattern over the words of a text. Rules hang on keywords: a text's rules are
those of the keywords it contains, so a text without any keyword costs a few substring searches, and no pattern runs
that cannot match. All places of the chosen patterns are found as intervals of words. An interval that lies within
that of a rule of higher priority (or of a longer interval of the same priority, or of an earlier rule on the same
words) is suppressed, so "GNU Lesser General Public License" is not also the general one. What remains gives labels;
the score is the confidence of the best of them.

Three base phrases are always reported with their places, whatever the rules say.

Everything is an expression on the row: no shuffle, nothing leaves its place. Words are runs of letters, digits and
non-ASCII characters after lower-casing A-Z. Nulls: a null text is empty. Repeated rows are scanned each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what separates words, before lower-casing
CONFIDENCE = [0.0, 0.4, 0.7, 1.0]  # by priority

# The phrases that are always reported, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Rules. A pattern is words with single blanks; "(a|b)" are choices, "x?" an optional word. A version "1.0" is the
# words "1 0". Priorities: 3 names a license and its version, 2 names a license, 1 points to a family or a notice.
VERSION = "(version|v|ver)?"
CREATIVE = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(ative|atives|s)", "by nc": "attribution non ?commercial",
            "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(ative|atives|s)"}
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {"gpl": ("general public licen[sc]e", ("1", "2", "3")), "lgpl": ("(lesser|library) general public licen[sc]e", ("2", "2.1", "3")),
       "agpl": ("affero general public licen[sc]e", ("1", "3")), "gfdl": ("free documentation licen[sc]e", ("1.1", "1.2", "1.3"))}
VERSIONED = {  # label: (keyword, name, versions)
    "apache": ("apache", "apache (software )?licen[sc]e", ("1.0", "1.1", "2.0")), "mpl": ("mozilla", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    "epl": ("eclipse", "eclipse public licen[sc]e", ("1.0", "2.0")), "cddl": ("common development", "common development and distribution licen[sc]e", ("1.0", "1.1")),
    "afl": ("academic free", "academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")), "osl": ("open software", "open software licen[sc]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    "eupl": ("european union public", "european union public licen[sc]e", ("1.0", "1.1", "1.2")), "artistic": ("artistic", "artistic licen[sc]e", ("1.0", "2.0")),
    "cpl": ("common public", "common public licen[sc]e", ("1.0",)), "lppl": ("latex", "latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3c")),
    "python": ("python", "python software foundation licen[sc]e", ("2",)), "boost": ("boost", "boost software licen[sc]e", ("1.0",)),
    "zpl": ("zope", "zope public licen[sc]e", ("1.1", "2.0", "2.1")), "ofl": ("open font", "(sil )?open font licen[sc]e", ("1.0", "1.1")),
    "openldap": ("openldap", "openldap public licen[sc]e", ("2.0", "2.7", "2.8")), "php": ("php", "php licen[sc]e", ("3.0", "3.01")),
    "npl": ("netscape", "netscape public licen[sc]e", ("1.0", "1.1")), "apsl": ("apple", "apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
    "cecill": ("cecill", "cecill( licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")), "odbl": ("open database", "open database licen[sc]e", ("1.0",)),
    "mspl": ("microsoft", "microsoft public licen[sc]e", ("1.0",)), "upl": ("universal permissive", "universal permissive licen[sc]e", ("1.0",)),
    "qpl": ("q public", "q public licen[sc]e", ("1.0",)), "ecl": ("educational community", "educational community licen[sc]e", ("1.0", "2.0")),
    "openrail": ("openrail", "open ?rail( licen[sc]e)?", ("1.0",)), "llama": ("llama", "llama( 2| 3)? community licen[sc]e", ("2", "3")),
}
NAMED = [  # (label, keyword, pattern, priority)
    ("mit", "mit", "mit licen[sc]e", 2), ("mit", "mit", "licen[sc]ed under( the)? mit", 2), ("mit", "expat", "expat licen[sc]e", 2),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 3),
    ("isc", "isc", "isc licen[sc]e", 2),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 3),
    ("bsd", "bsd", "bsd( style)? licen[sc]e", 2), ("bsd-2-clause", "bsd", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd licen[sc]e)", 3),
    ("bsd-3-clause", "bsd", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", 3),
    ("bsd-4-clause", "bsd", "(bsd 4 clause|4 clause bsd|original bsd|old bsd)", 3), ("0bsd", "bsd", "(0bsd|zero clause bsd|bsd zero clause)", 3),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3-clause", "neither the name", "neither the name of .{1,60}? nor the names of its contributors", 3),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", 3),
    ("zlib", "zlib", "zlib( libpng)? licen[sc]e", 2), ("zlib", "provided as is", "this software is provided as is without any express or implied warranty", 2),
    ("wtfpl", "wtfpl", "wtfpl", 2), ("wtfpl", "do what the", "do what the fuck you want to public licen[sc]e", 3), ("beerware", "beer", "beer ?ware licen[sc]e", 2),
    ("unlicense", "unlicense", "(the )?unlicense", 2), ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 3),
    ("public-domain", "public domain", "(released into|placed in|dedicated to|in) the public domain", 2), ("cc0", "cc0", "cc0( 1 0)?( universal)?", 3),
    ("cc0", "creative commons zero", "creative commons zero", 3), ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]", 3),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", 3), ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", 3),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", 3), ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", 3),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", 3), ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0", 3),
    ("creative-commons", "creative commons", "creative commons( licen[sc]e)?", 1), ("spdx", "spdx", "spdx license identifier", 1),
    ("postgresql", "postgresql", "postgresql licen[sc]e", 2), ("openssl", "openssl", "openssl licen[sc]e", 2), ("unicode", "unicode", "unicode licen[sc]e agreement", 2),
    ("ruby", "ruby", "ruby licen[sc]e", 2), ("vim", "vim", "vim licen[sc]e", 2), ("x11", "x11", "(mit )?x11 licen[sc]e", 2), ("ncsa", "ncsa", "ncsa open source licen[sc]e", 2),
    ("ncsa", "illinois", "university of illinois ncsa", 2), ("w3c", "w3c", "w3c software (notice and )?licen[sc]e", 2), ("intel", "intel", "intel open source licen[sc]e", 2),
    ("blueoak", "blue oak", "blue oak model licen[sc]e", 2), ("sspl", "server side public", "server side public licen[sc]e", 2), ("busl", "business source", "business source licen[sc]e", 2),
    ("elastic", "elastic", "elastic licen[sc]e", 2), ("polyform", "polyform", "polyform (noncommercial|small business|shield|strict) licen[sc]e", 2),
    ("gpl", "gpl", "gpl ?v?[123]?", 2), ("gpl", "gpl", "licen[sc]ed under( the)? gpl(?! ?v?[123])", 2), ("lgpl", "lgpl", "lgpl ?v?(2 1|2|3)?", 2), ("agpl", "agpl", "agpl ?v?[13]?", 2),
    ("apache", "apache", "licen[sc]ed under( the)? apache(?! licen[sc]e| software)", 2), ("reserved", "reserved", "(all|some) rights reserved", 1), ("no-rights-reserved", "reserved", "no rights reserved", 2),
    ("copyright", "copyright", "copyright (c )?((19|20)[0-9][0-9])", 1), ("proprietary", "proprietary", "proprietary and confidential", 2),
    ("proprietary", "confidential", "confidential and proprietary", 2), ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution|use)( of this file)?", 2),
    ("no-redistribution", "may not be", "may not be (reproduced|redistributed|copied|published)", 1), ("commercial", "commercial licen", "commercial licen[sc]e", 1),
    ("no-commercial-use", "commercial use", "(non commercial|no commercial|noncommercial) use( only)?", 1), ("fair-use", "fair use", "fair use", 1),
    ("press-agency", "reuters", "copyright .{0,20}?reuters", 1), ("terms-of-use", "terms of", "terms of (use|service)", 1),
]


def rules() -> list[tuple[int, str, str, int, str]]:
    """All rules in order: number, keyword, label, priority, pattern."""
    found = []
    for code, name in CREATIVE.items():
        label = "cc-" + code.replace(" ", "-")
        for version in CREATIVE_VERSIONS:
            plain = version.replace(".", " ")
            found.append(("cc by", f"{label}-{version}", 3, f"cc {code} {VERSION} ?{plain}"))
            found.append(("creative commons", f"{label}-{version}", 3, f"creative commons {name} ({VERSION} )?{plain}"))
        found.append(("cc by", label, 2, f"cc {code}"))
        found.append(("creative commons", label, 2, f"creative commons {name}"))
    for code, (name, versions) in GNU.items():
        for version in versions:
            plain = version.replace(".", " ")
            found.append(("public licen" if code != "gfdl" else "documentation licen", f"{code}-{version}", 3, f"(gnu )?{name} {VERSION} ?{plain}"))
            found.append((code, f"{code}-{version}", 3, f"(gnu )?{code} ?v?{plain}( (or later|only))?"))
            found.append(("public licen" if code != "gfdl" else "documentation licen", f"{code}-{version}-or-later", 3, f"(gnu )?{name} .{{0,40}}?version {plain} .{{0,60}}?any later version"))
        found.append(("public licen" if code != "gfdl" else "documentation licen", code, 2, f"(gnu )?{name}"))
    for code, (keyword, name, versions) in VERSIONED.items():
        for version in versions:
            plain = version.replace(".", " ")
            found.append((keyword, f"{code}-{version}", 3, f"{name} ({VERSION} )?{plain}"))
            found.append((code, f"{code}-{version}", 3, f"{code} {plain}"))
        found.append((keyword, code, 2, name))
    found.extend((keyword, label, priority, pattern) for label, keyword, pattern, priority in NAMED)
    return [(i, keyword, label, priority, pattern) for i, (keyword, label, priority, pattern) in enumerate(found)]


def _bounded(pattern: str) -> str:
    """The pattern as whole words, whatever the case of A-Z."""
    return rf"(?i)(?<![^ ])(?:{pattern})(?![^ ])"


def _word_count(text: Column) -> Column:
    """Words of a text in which single blanks separate them."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long")


def _intervals(text: Column, rule: Column) -> Column:
    """All places of a rule as intervals of words, ready to be ordered: start, -end, -priority, rule."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start: bigint, end: bigint, priority: int, no: int, label: string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + _word_count(F.trim(part["gap"]))
        end = start + _word_count(F.coalesce(part["match"], F.lit("")))
        found = F.struct(start.alias("start"), (-end).alias("end"), (-rule["priority"]).alias("priority"), rule["no"].alias("no"), rule["label"].alias("label"))
        out = F.when(part["match"].isNull(), state["out"]).otherwise(F.array_append(state["out"], found))
        return F.struct(end.alias("at"), out.alias("out"))

    gaps, matches = F.split(text, rule["pattern"]), F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    parts = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(parts, F.struct(zero.alias("at"), none.alias("out")), step, lambda state: state["out"])


def _surviving(intervals: Column) -> Column:
    """Labels of the intervals that no interval before them in order (and of no lower priority) contains; best priority.

    In the order of start, -end, -priority and rule, whatever contains an interval stands before it, so it is enough
    to know how far the intervals of each priority have reached.
    """

    def step(state: Column, x: Column) -> Column:
        end, priority = -x["end"], -x["priority"]
        reached = [F.greatest(state[f"p{k}"], *([state[f"p{j}"] for j in range(k + 1, 4)] or [F.lit(-1).cast("long")])) for k in (1, 2, 3)]
        kept = F.when(priority == 1, reached[0]).when(priority == 2, reached[1]).otherwise(reached[2]) < end
        further = [F.when(kept & (priority == k), F.greatest(state[f"p{k}"], end)).otherwise(state[f"p{k}"]).alias(f"p{k}") for k in (1, 2, 3)]
        labels = F.when(kept, F.array_union(state["labels"], F.array(x["label"]))).otherwise(state["labels"])
        best = F.when(kept, F.greatest(state["best"], priority)).otherwise(state["best"])
        return F.struct(*further, labels.alias("labels"), best.alias("best"))

    start = [F.lit(-1).cast("long").alias(f"p{k}") for k in (1, 2, 3)]
    nothing = F.struct(*start, F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    return F.aggregate(F.sort_array(intervals), nothing, step, lambda s: F.struct(s["labels"].alias("labels"), s["best"].alias("best")))


def _chosen(low: Column) -> Column:
    """The rules of all keywords in a lower-case text of words."""
    by_keyword: dict[str, list[Column]] = {}
    for no, keyword, label, priority, pattern in rules():
        rule = F.struct(F.lit(no).alias("no"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(_bounded(pattern)).alias("pattern"))
        by_keyword.setdefault(keyword, []).append(rule)
    empty = F.array().cast("array<struct<no: int, label: string, priority: int, pattern: string>>")
    return F.concat(*(F.when(F.contains(low, F.lit(k)), F.array(*found)).otherwise(empty) for k, found in by_keyword.items()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_words``, the base phrases (``n_base``, ``first_word``, ``last_word``, ``base_labels``), ``labels`` and ``score``."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAPS, " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).withColumn("low", F.lower("words"))
    text, any_base = F.col("words"), _bounded("|".join(BASE))
    has = {phrase: F.contains("low", F.lit(phrase)) & text.rlike(_bounded(phrase)) for phrase in BASE}
    rows = rows.select("doc_id", "words", _chosen(F.col("low")).alias("rules"), F.array_compact(F.array(*(F.when(has[p], F.lit(x)) for p, x in BASE.items()))).alias("base"))
    based = F.size("base") > 0
    hits = F.flatten(F.transform("rules", lambda rule: _intervals(F.col("words"), rule)))
    rows = rows.select(
        "doc_id",
        _word_count(text).alias("n_words"),
        "base",
        F.when(based, F.regexp_extract_all("words", F.lit(any_base), F.lit(0))).alias("matches"),
        F.when(based, F.split("words", any_base)).alias("gaps"),
        F.when(F.size("rules") > 0, _surviving(hits)).alias("found"),
    )
    last = F.col("n_words") - _word_count(F.trim(F.element_at("gaps", -1))) - _word_count(F.element_at("matches", -1))
    sorted_list = F.array_join(F.array_sort("base"), ",")
    every = F.array_sort(F.array_union("base", F.coalesce("found.labels", F.array().cast("array<string>"))))
    best = F.greatest(F.coalesce("found.best", F.lit(0)), F.when(F.size("base") > 0, 1).otherwise(0))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size("base") > 0, _word_count(F.trim(F.element_at("gaps", 1)))).alias("first_word"),
        F.when(F.size("base") > 0, last).alias("last_word"),
        sorted_list.alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), best + 1).alias("score"),
    )
