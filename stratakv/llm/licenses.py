"""License scans: ordered signature rules on normalised words.

A text becomes its words (see below), lower-cased and joined by single spaces. A rule has a license, keywords, words of its
form, a regular expression, a priority and a weight; every match holds one of its keywords and one of its form's words, so a
rule without either is not tried, and texts without any form's word are not looked at further. Matches become word intervals; an interval that lies inside another one is suppressed
(of equal ones the rule of higher priority stays). What is left gives the labels; the score is the largest weight.

Rules are the product of the table of names below and of the ways in which licenses are stated; base phrases are always
kept. Everything is in-row built-in functions: no shuffle, no Python. A null text is empty. Repeated rows give repeated
rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: License label, keywords (each alternative of the names holds one), names in normalised words (regular expressions).
NAMES = (
    ("mit", "mit expat x11", "(?:the )?(?:mit|expat|x11)(?: x11| expat)?"),
    ("mit-0", "attribution", "mit no attribution"),
    ("apache-1", "apache", "(?:the )?apache (?:software )?(?:license )?(?:version |v)?1(?: [01])?"),
    ("apache-2", "apache", "(?:the )?apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2(?: clause)?"),
    ("bsd-3-clause", "bsd", "(?:the )?(?:new|modified|revised|3 clause|three clause) bsd|bsd 3(?: clause)?"),
    ("bsd-4-clause", "bsd", "(?:the )?(?:original|old|4 clause|four clause) bsd|bsd 4(?: clause)?"),
    ("bsd", "bsd", "(?:the |a )?bsd(?: style)?"),
    ("isc", "isc", "(?:the )?isc"),
    ("0bsd", "0bsd zero", "(?:the )?(?:0bsd|zero clause bsd)"),
    ("gpl-1", "general gpl gpl1 gplv1", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v?1(?: 0)?"),
    ("gpl-2", "2", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? 2(?: 0)?"),
    ("gpl-2", "gplv2", "(?:the )?(?:gnu )?gplv2"),
    ("gpl-3", "3", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? 3(?: 0)?"),
    ("gpl-3", "gplv3", "(?:the )?(?:gnu )?gplv3"),
    ("gpl", "gpl", "(?:the )?(?:gnu )?gpl"),
    ("gpl", "general", "(?:the )?(?:gnu )?general public"),
    ("lgpl-2", "2", "(?:the )?(?:gnu )?(?:lesser |library )(?:general public license|gpl)(?: version)? 2(?: 0)?"),
    ("lgpl-2-1", "2", "(?:the )?(?:gnu )?(?:lesser general public license|lesser gpl|lgpl)(?: version)? 2 1"),
    ("lgpl-3", "3", "(?:the )?(?:gnu )?(?:lesser general public license|lesser gpl|lgpl)(?: version)? 3(?: 0)?"),
    ("lgpl", "lgpl", "(?:the )?(?:gnu )?lgpl"),
    ("agpl-3", "3", "(?:the )?(?:gnu )?(?:affero general public license|agpl)(?: version)? 3(?: 0)?"),
    ("agpl", "agpl", "(?:the )?(?:gnu )?agpl"),
    ("gfdl", "documentation", "(?:the )?gnu free documentation"),
    ("mpl-1-1", "1", "(?:the )?(?:mozilla public license|mpl)(?: version)? 1 1"),
    ("mpl-2", "2", "(?:the )?(?:mozilla public license|mpl)(?: version)? 2(?: 0)?"),
    ("mpl", "mozilla", "(?:the )?mozilla public"),
    ("epl-1", "1", "(?:the )?(?:eclipse public license|epl)(?: version)? 1(?: 0)?"),
    ("epl-2", "2", "(?:the )?(?:eclipse public license|epl)(?: version)? 2(?: 0)?"),
    ("cddl", "cddl", "(?:the )?cddl(?: 1 [01])?"),
    ("cddl", "distribution", "(?:the )?common development and distribution"),
    ("cpl-1", "common", "(?:the )?common public"),
    ("eupl", "european", "(?:the )?european union public"),
    ("eupl", "eupl", "(?:the )?eupl(?: 1 [012])?"),
    ("artistic-1", "artistic", "(?:the )?(?:perl )?artistic(?: license)? 1(?: 0)?"),
    ("artistic-2", "artistic", "(?:the )?artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", "(?:the )?artistic"),
    ("bsl-1", "boost", "(?:the )?boost software(?: license)?(?: version)?(?: 1)?(?: 0)?"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?"),
    ("libpng", "libpng", "(?:the )?libpng"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl"),
    ("cc0", "cc0", "cc0(?: 1)?(?: 0)?"),
    ("cc0", "zero", "creative commons zero"),
    ("cc-by", "by", "(?:cc|creative commons) by(?: [1234])?(?: [05])?"),
    ("cc-by", "attribution", "(?:a |the )?creative commons attribution(?: [1234] [05])?"),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa(?: [1234])?(?: [05])?"),
    ("cc-by-sa", "attribution", "(?:a |the )?creative commons attribution share ?alike(?: [1234] [05])?"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc(?: [1234])?(?: [05])?"),
    ("cc-by-nc", "attribution", "(?:a |the )?creative commons attribution non ?commercial(?: [1234] [05])?"),
    ("cc-by-nc-sa", "nc", "(?:cc|creative commons) by nc sa(?: [1234])?(?: [05])?"),
    ("cc-by-nc-nd", "nc", "(?:cc|creative commons) by nc nd(?: [1234])?(?: [05])?"),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd(?: [1234])?(?: [05])?"),
    ("cc-by-nd", "attribution", "(?:a |the )?creative commons attribution no ?deriv(?:ative)?s?"),
    ("odbl", "database", "(?:the )?open database"),
    ("odc-by", "odc attribution", "odc by|open data commons attribution"),
    ("ofl-1-1", "font", "(?:the )?(?:sil )?open font"),
    ("python-2", "python psf", "(?:the )?(?:psf|python software foundation|python)"),
    ("ruby", "ruby", "(?:the )?ruby"),
    ("php-3", "php", "(?:the )?php"),
    ("openssl", "openssl", "(?:the )?openssl"),
    ("postgresql", "postgresql", "(?:the )?postgresql"),
    ("ncsa", "ncsa", "(?:the )?(?:university of illinois )?ncsa(?: open source)?"),
    ("ms-pl", "microsoft", "(?:the )?microsoft public"),
    ("ms-rl", "microsoft", "(?:the )?microsoft reciprocal"),
    ("bsl-1-1", "business", "(?:the )?business source"),
    ("sspl-1", "server", "(?:the )?server side public"),
    ("elastic-2", "elastic", "(?:the )?elastic"),
)

#: How a license is stated: name, words of which one is in the expression, expression around the name, priority (1 is first), weight.
FORMS = (
    ("identifier", "spdx", "spdx license identifier {0}(?: only| or later)?", 1, 1.0),
    ("notice", "under", "(?:released|licensed|distributed|available|provided|made available|published|covered) (?:as free software )?under (?:the terms of )?{0}(?: license| licence)?", 2, 0.95),
    ("terms", "terms", "(?:the )?terms (?:and conditions )?of {0}(?: license| licence)?", 3, 0.85),
    ("title", "license licence", "{0} (?:public )?(?:license|licence)", 4, 0.75),
    ("field", "license licence", "licen[sc]e {0}", 5, 0.7),
)

#: Statements without a license's name: label, keyword, expression, priority, weight.
STATEMENTS = (
    ("all-rights-reserved", "reserved", "all rights reserved", 6, 0.6),
    ("public-domain", "domain", "(?:released into|placed in|dedicated to|is in) the public domain", 2, 0.9),
    ("public-domain", "domain", "public domain dedication", 3, 0.85),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 3, 0.8),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.98),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee", 2, 0.98),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 2, 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 2, 0.97),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 7, 0.5),
    ("apache-2", "apache", "www apache org licenses license 2 0", 2, 0.98),
    ("mit", "opensource", "opensource org licenses mit", 2, 0.95),
    ("gpl", "gnu", "www gnu org licenses", 3, 0.8),
    ("creative-commons", "creativecommons", "creativecommons org licenses", 3, 0.8),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero", 2, 0.95),
)

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    names: tuple = NAMES
    forms: tuple = FORMS
    statements: tuple = STATEMENTS


def rules(params: Params) -> list[tuple[str, str, str, int, float, str]]:
    """(label, keywords, expression, priority, weight, words of the form), in order."""
    out = [(label, words, form.format(f"(?:{name})"), priority, weight, held) for label, words, name in params.names for _, held, form, priority, weight in params.forms]
    return sorted([*out, *((*x, x[1]) for x in params.statements)], key=lambda r: r[3])


def gate(params: Params) -> str:
    """What every text that a rule or base phrase matches holds: a word of a rule's form, or the phrase."""
    held = sorted({w for r in rules(params) for w in r[5].split()})
    inside = SEPARATOR[1:-2]
    return f"(?i)(?:^|[{inside}])(?:{'|'.join(held)})(?:$|[{inside}])|" + "|".join(p.replace(" ", SEPARATOR) for p, _ in BASE)


def _places(expression: Column) -> Column:
    """Of marked text, the word places (from 0) where matches begin and end, as (s, e)."""
    tokens = F.split(expression, " ")
    begin = F.filter(F.transform(tokens, lambda t, i: F.when(t.startswith("\x01"), i - 1)), lambda x: x.isNotNull())
    end = F.filter(F.transform(tokens, lambda t, i: F.when(t.endswith("\x02"), i)), lambda x: x.isNotNull())
    return F.transform(F.arrays_zip(begin.alias("s"), end.alias("e")), lambda x: F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e")))


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each row of docs: counts, first and last word of base places, labels, score, and the kept spans."""
    table = rules(params)
    held = lambda words: "array(" + ",".join(repr(f" {w} ") for w in words.split()) + ")"
    each = "named_struct('label',{},'words',{},'rule',{},'priority',{},'weight',{}D)"
    groups = {form: ",".join(each.format(repr(a), held(b), repr(f"(?<= )({c})(?= )"), d, w) for a, b, c, d, w, f in table if f == form) for form in dict.fromkeys(x[5] for x in table)}
    flat = "array(" + ",".join(f"named_struct('words',{held(form)},'rules',array({inner}))" for form, inner in groups.items()) + ")"
    some = lambda x: f"exists({x}.words, w -> contains(_norm, w))"
    tried = f"filter(flatten(transform(filter({flat}, g -> {some('g')}), g -> g.rules)), r -> {some('r')})"
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("_text"))
    df = df.withColumn("n_words", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    df = df.withColumn("_gated", shared.once(F.col("_text").rlike(gate(params))))
    fold = F.translate(F.regexp_replace("_text", SEPARATOR, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("_norm", shared.once(F.when(F.col("_gated"), F.concat(F.lit(" "), F.trim(fold), F.lit(" "))))).drop("_text", "_gated")
    for i, (phrase, _) in enumerate(BASE):
        marked = F.regexp_replace("_norm", f"(?<= )({phrase})(?= )", "\x01$1\x02")
        df = df.withColumn(f"_base{i}", shared.once(F.when(F.contains("_norm", F.lit(f" {phrase} ")), F.transform(_places(marked), lambda x: x["s"])).otherwise(F.array().cast("array<bigint>"))))
    df = df.withColumn("_rules", shared.once(F.when(F.col("_norm").isNotNull(), F.expr(tried))))
    each = F.transform("_rules", lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), _places(F.regexp_replace(F.col("_norm"), r["rule"], F.lit("\x01$1\x02"))).alias("at")))
    spans = F.flatten(F.transform(each, lambda r: F.transform(r["at"], lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))))
    df = df.withColumn("_spans", shared.once(F.sort_array(F.coalesce(spans, F.array().cast("array<struct<s:bigint,e:bigint,priority:int,label:string,weight:double>>"))))).drop("_rules", "_norm")
    # in this order a span lies inside an earlier one when an earlier end reaches its own
    sweep = "aggregate(_spans, named_struct('far', -1L, 'labels', cast(array() as array<string>), 'score', 0D, 'n', 0L), (a, x) -> if(-x.e <= a.far, a, named_struct('far', -x.e, 'labels', array_union(a.labels, array(x.label)), 'score', greatest(a.score, x.weight), 'n', a.n + 1L)))"
    df = df.withColumn("_found", shared.once(F.expr(sweep))).withColumn("_all", shared.once(F.flatten(F.array(*[F.col(f"_base{i}") for i in range(len(BASE))]))))
    base = F.array_compact(F.array(*[F.when(F.size(f"_base{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    return df.select(
        "doc_id",
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").alias("first_word"),
        F.array_max("_all").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("_found.labels"))), ",").alias("labels"),
        F.greatest("_found.score", F.when(F.size("_all") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.col("_found.n").alias("n_detections"),
    )
