"""License scan by ordered signature rules.

Rules are regular expressions over the lower-cased text with runs of white space as one space: for each family
of licences the ways of naming it, its identifier beside others, its short name with a version, the
addresses of its text, and sentences of the texts and of file headers. A text without any family's keyword is passed over; otherwise only the rules are tried of which it
has a keyword (each way of writing the name or identifier has one), in order of priority. A detection inside the interval of one with
higher priority, or inside a longer one of the same priority, is dropped, so that "GNU Lesser General
Public License" is not a GPL notice as well. Base phrases are found apart, as word runs, and their
labels are always reported.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.llm.text import LOWER, folded_words, narrow, raw_texts

# Phrase (its words) and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# label: (keywords between |, of which every form of the name has one; pattern of the name; SPDX identifier pattern)
FAMILIES = {
    "agpl": ("affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl-[\d.]+(?:-only|-or-later|\+)?"),
    "lgpl": ("general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl-[\d.]+(?:-only|-or-later|\+)?"),
    "gpl": ("general public", r"(?:gnu )?general public licen[cs]e", r"gpl-[\d.]+(?:-only|-or-later|\+)?"),
    "gfdl": ("documentation licen", r"(?:gnu )?free documentation licen[cs]e", r"gfdl-[\d.]+(?:-only|-or-later)?"),
    "apache": ("apache", r"apache(?: software)? licen[cs]e", r"apache-[\d.]+"),
    "mit": ("mit|expat|x11", r"(?:mit|expat|x11) licen[cs]e", r"mit(?:-0)?"),
    "bsd": ("bsd", r"(?:(?:new|modified|simplified|revised|original) bsd(?: licen[cs]e)?|bsd[ -][0-4][ -]clause(?: licen[cs]e)?|[0-4][ -]clause bsd(?: licen[cs]e)?|bsd licen[cs]e)", r"(?:0bsd|bsd(?:-[0-4]-clause(?:-[a-z]+)?)?)"),
    "mpl": ("mozilla", r"mozilla public licen[cs]e", r"mpl-[\d.]+"),
    "epl": ("eclipse", r"eclipse public licen[cs]e", r"epl-[\d.]+"),
    "edl": ("eclipse", r"eclipse distribution licen[cs]e", r"edl-[\d.]+"),
    "cddl": ("distribution licen", r"common development and distribution licen[cs]e", r"cddl-[\d.]+"),
    "cpl": ("common public", r"common public licen[cs]e", r"cpl-[\d.]+"),
    "ipl": ("ibm public", r"ibm public licen[cs]e", r"ipl-[\d.]+"),
    "eupl": ("european union public", r"european union public licen[cs]e", r"eupl-[\d.]+"),
    "isc": ("isc", r"isc licen[cs]e", r"isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib"),
    "boost": ("boost", r"boost software licen[cs]e", r"bsl-1\.0"),
    "artistic": ("artistic", r"artistic licen[cs]e", r"artistic-[\d.]+"),
    "python": ("python", r"python(?: software foundation)? licen[cs]e", r"(?:psf|python)-[\d.]+"),
    "php": ("php", r"php licen[cs]e", r"php-[\d.]+"),
    "ruby": ("ruby", r"ruby licen[cs]e", r"ruby"),
    "zope": ("zope", r"zope public licen[cs]e", r"zpl-[\d.]+"),
    "w3c": ("w3c", r"w3c (?:software )?licen[cs]e", r"w3c"),
    "wtfpl": ("want to public", r"do what the fuck you want to public licen[cs]e", r"wtfpl"),
    "unlicense": ("unlicen", r"(?:the )?unlicen[cs]e", r"unlicense"),
    "cc0": ("cc0|creative commons zero", r"(?:creative commons zero|cc0)(?: universal)?", r"cc0-[\d.]+"),
    "cc-by-nc-nd": ("cc|attribution", r"(?:cc[ -]by[ -]nc[ -]nd|(?:creative commons )?attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?)", r"cc-by-nc-nd-[\d.]+"),
    "cc-by-nc-sa": ("cc|attribution", r"(?:cc[ -]by[ -]nc[ -]sa|(?:creative commons )?attribution[ -]non-?commercial[ -]share-?alike)", r"cc-by-nc-sa-[\d.]+"),
    "cc-by-nc": ("cc|attribution", r"(?:cc[ -]by[ -]nc|(?:creative commons )?attribution[ -]non-?commercial)", r"cc-by-nc-[\d.]+"),
    "cc-by-nd": ("cc|attribution", r"(?:cc[ -]by[ -]nd|(?:creative commons )?attribution[ -]no-?deriv(?:ative)?s?)", r"cc-by-nd-[\d.]+"),
    "cc-by-sa": ("cc|attribution", r"(?:cc[ -]by[ -]sa|(?:creative commons )?attribution[ -]share-?alike)", r"cc-by-sa-[\d.]+"),
    "cc-by": ("cc|creative commons attribution", r"(?:cc[ -]by|creative commons attribution(?: licen[cs]e)?)", r"cc-by-[\d.]+"),
    "odbl": ("open d", r"open (?:data commons )?(?:open )?database licen[cs]e", r"odbl-[\d.]+"),
    "odc-by": ("open data commons", r"open data commons attribution licen[cs]e", r"odc-by-[\d.]+"),
    "pddl": ("public domain", r"public domain dedication and licen[cs]e", r"pddl-[\d.]+"),
    "ofl": ("open font", r"(?:sil )?open font licen[cs]e", r"ofl-[\d.]+"),
    "osl": ("open software licen", r"open software licen[cs]e", r"osl-[\d.]+"),
    "afl": ("academic free", r"academic free licen[cs]e", r"afl-[\d.]+"),
    "ms-pl": ("microsoft public", r"microsoft public licen[cs]e", r"ms-pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms-rl"),
    "qpl": ("q public", r"q public licen[cs]e", r"qpl-[\d.]+"),
    "bsl": ("business source", r"business source licen[cs]e", r"busl-[\d.]+"),
    "sspl": ("server side public", r"server side public licen[cs]e", r"sspl-[\d.]+"),
    "elastic": ("elastic", r"elastic licen[cs]e", r"elastic-[\d.]+"),
    "rail": ("rail", r"(?:open|creativeml open)rail(?:-[ms]+)?(?: licen[cs]e)?", r"openrail(?:\+\+)?"),
}
VERSION = r",?(?: v(?:ersion)?\.? ?)?(?: ?\d+(?:\.\d+)*)"
# name: (priority, weight in the score, pattern with the family's name or SPDX identifier)
WAYS = {
    "spdx": (6, 1.0, r"(?<![a-z0-9-])spdx-license-identifier:? ?\(?(?:[a-z0-9.+-]+ (?:or|and|with) \(?){{0,8}}\K{spdx}(?![a-z0-9])"),
    "grant-version": (5, 0.95, r"(?<![a-z0-9-])(?:licen[cs]ed|released|distributed|available|published|redistribute it(?: and/or modify it)?|covered)"
                               r" (?:under|by)(?: the)?(?: terms of)?(?: the)? {name}{version}"),
    "grant": (4, 0.9, r"(?<![a-z0-9-])(?:licen[cs]ed|released|distributed|available|published|redistribute it(?: and/or modify it)?|covered)"
                      r" (?:under|by)(?: the)?(?: terms of)?(?: the)? {name}\b"),
    "field": (3, 0.85, r"(?<![a-z0-9-])\"?licen[cs]es?\"? ?[:=] ?[\"(]*(?:[a-z0-9.+-]+ (?:or|and) \(?){{0,8}}\K(?:{name}|{spdx})(?![a-z0-9])"),
    "title": (2, 0.7, r"\b{name}{version}"),
    "mention": (1, 0.5, r"\b{name}\b"),
}
# Two identifiers joined, of which one has a version: either may be the family's.
VERSIONED = r"[a-z]+(?:-[a-z]+)*-[0-9](?:\.[0-9])*(?:-[a-z]+)*"
EXPRESSION = (3, 0.85, r"(?<![a-z0-9.-]){spdx}(?= (?:or|and) \(?{versioned}(?![a-z0-9]))",
              r"(?<![a-z0-9.-]){left}\+? (?:or|and) \(?\K{spdx}(?![a-z0-9])")
# label: (short name, its keyword, versions): written with a version and no word "license".
SHORT_NAMES = {
    "agpl": ("agpl", "agpl", "[13]"), "lgpl": ("lgpl", "lgpl", "[23]"), "gpl": ("gpl", "gpl", "[123]"), "gfdl": ("gfdl", "gfdl", "1"),
    "mpl": ("mpl", "mpl", "[12]"), "epl": ("epl", "epl", "[12]"), "cddl": ("cddl", "cddl", "1"), "eupl": ("eupl", "eupl", "1"),
    "apache": ("apache", "apache", "[12]"), "ofl": ("ofl", "ofl", "1"), "osl": ("osl", "osl", "[123]"), "zope": ("zpl", "zpl", "[12]"),
}
# Priority, weight and pattern of a short name.
SHORT = (2, 0.7, r"(?<![a-z0-9/.-])(?:gnu )?{short},?(?:[ -]?v(?:ersion|er)?\.?)?[ -]?{versions}(?:\.[0-9])*(?: or later|-or-later|-only|\+)?(?![a-z0-9]|\.[a-z])")
# label: [(keyword, pattern)]: addresses of licence texts.
ADDRESSES = {
    "cc-by": [("creativecommons.org", r"creativecommons\.org/licenses/by/")], "cc-by-sa": [("creativecommons.org", r"creativecommons\.org/licenses/by-sa\b")],
    "cc-by-nd": [("creativecommons.org", r"creativecommons\.org/licenses/by-nd\b")],
    "cc-by-nc": [("creativecommons.org", r"creativecommons\.org/licenses/by-nc/")],
    "cc-by-nc-sa": [("creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa\b")],
    "cc-by-nc-nd": [("creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd\b")],
    "cc0": [("creativecommons.org", r"creativecommons\.org/publicdomain/zero\b")],
    "public-domain": [("creativecommons.org", r"creativecommons\.org/publicdomain/mark\b")],
    "apache": [("apache.org", r"apache\.org/licenses/license-[12]"), ("opensource.org", r"opensource\.org/licenses?/apache")],
    "mit": [("opensource.org", r"opensource\.org/licenses?/mit\b"), ("choosealicense.com", r"choosealicense\.com/licenses/mit\b")],
    "bsd": [("opensource.org", r"opensource\.org/licenses?/(?:[a-z]+-)?(?:[0-9]-clause-)?bsd"), ("opensource.org", r"opensource\.org/licenses?/bsd")],
    "gpl": [("gnu.org", r"gnu\.org/(?:copyleft|licenses(?:/old-licenses)?)/gpl\b"), ("opensource.org", r"opensource\.org/licenses?/gpl")],
    "lgpl": [("gnu.org", r"gnu\.org/(?:copyleft/lesser|licenses(?:/old-licenses)?/lgpl\b)"), ("opensource.org", r"opensource\.org/licenses?/lgpl")],
    "agpl": [("gnu.org", r"gnu\.org/licenses/agpl\b"), ("opensource.org", r"opensource\.org/licenses?/agpl")],
    "gfdl": [("gnu.org", r"gnu\.org/(?:copyleft|licenses(?:/old-licenses)?)/fdl\b")],
    "mpl": [("mozilla.org", r"mozilla\.org/mpl\b"), ("opensource.org", r"opensource\.org/licenses?/mpl")],
    "epl": [("eclipse.org", r"eclipse\.org/legal/epl\b")], "edl": [("eclipse.org", r"eclipse\.org/(?:org/documents|legal)/edl\b")],
    "boost": [("boost.org", r"boost\.org/license_1_0")], "unlicense": [("unlicense.org", r"(?<![a-z0-9-])unlicense\.org")],
    "wtfpl": [("wtfpl.net", r"wtfpl\.net")], "ofl": [("sil.org/ofl", r"scripts\.sil\.org/ofl")], "isc": [("opensource.org", r"opensource\.org/licenses?/isc\b")],
    "odbl": [("opendatacommons.org", r"opendatacommons\.org/licenses/odbl")], "odc-by": [("opendatacommons.org", r"opendatacommons\.org/licenses/by\b")],
    "pddl": [("opendatacommons.org", r"opendatacommons\.org/licenses/pddl")], "zlib": [("opensource.org", r"opensource\.org/licenses?/zlib")],
}
ADDRESS = (5, 0.95)
# (label, keyword, priority, weight, pattern): sentences of licence texts and file headers.
SENTENCES = (
    ("mpl", "mpl", 5, 0.95, r"subject to the terms of the mpl,? v(?:ersion|\.)? ?[12]"),
    ("mpl", "mozilla", 5, 0.95, r"subject to the (?:terms of the )?mozilla public licen[cs]e"),
    ("gpl", "free software", 5, 0.95, r"is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "free software", 5, 0.95, r"is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "free software", 5, 0.95, r"is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "gnu general public", 4, 0.9, r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "general public", 4, 0.9, r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("bsd", "endorse or promote", 5, 0.95, r"may be used to endorse or promote products derived from this software"),
    ("zlib", "be held liable", 5, 0.95, r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", 6, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("boost", "person or organization", 6, 1.0, r"permission is hereby granted, free of charge, to any person or organi[sz]ation obtaining a copy"),
    ("wtfpl", "what the fuck", 5, 0.95, r"you just do what the fuck you want to"),
    ("cc0", "related rights", 5, 0.95, r"waived all copyright and related (?:or|and) neighboring rights"),
    ("proprietary", "confidential", 3, 0.7, r"confidential and proprietary|unauthori[sz]ed copying of this (?:file|software)"),
    ("as-is", "provided", 2, 0.4, r"(?:software|program|work|material) is provided (?:on an )?[\"'(]*as[ -]is"),
)
# label: (keyword, priority, weight, pattern): notices that name no family.
PLAIN_RULES = {
    "public-domain": ("public domain", 4, 0.8, r"(?:(?:is|are|placed|dedicated|released) (?:in|to|into) the public domain|public domain dedication)"),
    "all-rights-reserved": ("rights reserved", 3, 0.6, r"all rights reserved"),
    "proprietary": ("proprietary", 3, 0.7, r"proprietary(?: and confidential| licen[cs]e| software)"),
    "mit-text": ("permission is hereby granted", 6, 1.0, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    "isc-text": ("permission to use, copy", 6, 0.95, r"permission to use, copy, modify,? and(?:/or)? distribute this software"),
    "bsd-text": ("redistribution and use", 6, 1.0, r"redistribution and use in source and binary forms"),
    "copyright": ("copyright", 1, 0.3, r"copyright (?:\(c\)|©)? ?\d{4}"),
}
LABEL_OF = {"mit-text": "mit", "isc-text": "isc", "bsd-text": "bsd"}
# Without one of these a text has no notice of any rule.
ANCHORS = (b"gpl", b"mpl", b"epl", b"eupl", b"gfdl", b"cddl", b"osl", b"zpl", b"apache", b"mozilla.org", b"attribution", b"creativecommons", b"free software",
           b"unencumbered", b"held liable", b"endorse or promote", b"what the fuck", b"related rights", b"opendatacommons", b"confidential", b"is provided",
           b"wtfpl", b"boost.org", b"eclipse.org", b"sil.org", b"licen", b"copyright", b"spdx", b"public domain", b"rights reserved", b"cc by", b"cc-by", b"cc0", b"creative commons",
           b"proprietary", b"permission", b"redistribution", b"bsd", b"rail")


@dataclass(frozen=True)
class Signature:
    label: str
    keywords: tuple[bytes, ...]
    priority: int
    weight: float
    pattern: regex.Pattern


def _expressions() -> Iterator[tuple[str, str, str]]:
    """(label, SPDX pattern, pattern) of identifiers that stand beside another one."""
    priority, weight, first, second = EXPRESSION
    for label, (_, _, spdx) in FAMILIES.items():
        yield label, spdx, first.format(spdx=spdx, versioned=VERSIONED)
        # What has a version of its own may stand beside any identifier.
        left = r"[a-z][a-z0-9.]*(?:-[a-z0-9.]+)*" if r"[\d.]" in spdx else VERSIONED
        yield label, spdx, second.format(spdx=spdx, left=left)


def _keywords(way: str, keyword: str, spdx: str) -> tuple[bytes, ...]:
    """What a text must have one of: the name's keywords, in a field also the identifier's first letters."""
    if way == "spdx":
        return (b"spdx",)
    stems = []
    if way in ("field", "expression"):
        forms = regex.match(r"\(\?:([^)]*)", spdx)
        stems = [regex.match(r"[a-z0-9-]+", f)[0] for f in (forms[1].split("|") if forms else [spdx])]
    names = [] if way == "expression" else keyword.split("|")
    return tuple(k.encode() for k in dict.fromkeys([*names, *stems]))


@functools.lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules, highest priority first."""
    out = [
        Signature(label, _keywords(way, keyword, spdx), priority, weight,
                  regex.compile(text.format(name=name, spdx=spdx, version=VERSION).encode()))
        for (label, (keyword, name, spdx)), (way, (priority, weight, text)) in itertools.product(FAMILIES.items(), WAYS.items())
    ]
    out += [Signature(LABEL_OF.get(label, label), (keyword.encode(),), priority, weight, regex.compile(text.encode()))
            for label, (keyword, priority, weight, text) in PLAIN_RULES.items()]
    priority, weight, *_ = EXPRESSION
    out += [Signature(label, _keywords("expression", "", spdx), priority, weight, regex.compile(text.encode()))
            for label, spdx, text in _expressions()]
    priority, weight, text = SHORT
    out += [Signature(label, (keyword.encode(),), priority, weight, regex.compile(text.format(short=short, versions=versions).encode()))
            for label, (short, keyword, versions) in SHORT_NAMES.items()]
    out += [Signature(label, (keyword.encode(),), *ADDRESS, regex.compile(text.encode()))
            for label, places in ADDRESSES.items() for keyword, text in places]
    out += [Signature(label, (keyword.encode(),), priority, weight, regex.compile(text.encode()))
            for label, keyword, priority, weight, text in SENTENCES]
    return tuple(sorted(out, key=lambda s: (-s.priority, s.label, s.pattern.pattern)))


def detections(text: bytes) -> list[tuple[str, float, int, int]]:
    """(label, weight, start, end) in bytes of the lower-cased text with single spaces, overlaps resolved."""
    squeezed = b" ".join(text.translate(LOWER).split())
    if not any(a in squeezed for a in ANCHORS):
        return []
    has = functools.cache(squeezed.__contains__)
    found = [(s.priority, m.start(), m.end(), s.label, s.weight)
             for s in signatures() if any(map(has, s.keywords)) for m in s.pattern.finditer(squeezed)]
    kept = resolved(found)
    return [(label, weight, start, end) for _, start, end, label, weight in kept]


def resolved(found: list[tuple]) -> list[tuple]:
    """Detections (priority, start, end, label, weight) in order of place, without those inside another one of
    higher priority, or of the same priority and longer, or, in the same place, first by label."""
    kept: list[tuple] = []
    for priority in sorted({f[0] for f in found}, reverse=True):
        own = [f for f in found if f[0] == priority]
        reach, out = -1, []
        # Those already kept come first where they begin at the same place, then the longest.
        for one in sorted(kept + own, key=lambda f: (f[1], f[0] == priority, -f[2], f[3])):
            if one[0] > priority or one[2] > reach:
                out.append(one)
            reach = max(reach, one[2])
        kept = out
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand one after the other."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE_PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            found.append((at, label))
            at = joined.find(sought, at + 1)
    if not found:
        return []
    # A place is the blank before a word: its rank among the blanks is the word's number.
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return sorted(zip(np.searchsorted(blanks, [at for at, _ in found]).tolist(), [label for _, label in found]))


COLUMNS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "found array<struct<label:string,weight:double,start:long,end:long>>")


def _scanner(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema if f.name != "doc_id"}
            for text in raw_texts(batch.column("text")):
                words = folded_words(text)
                places, found = base_places(words), detections(text)
                base = {label for _, label in places}
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(places[0][0] if places else None)
                out["last_word"].append(places[-1][0] if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {f[0] for f in found})))
                out["score"].append(max([f[1] for f in found] + [0.5] * bool(base), default=0.0))
                out["found"].append([dict(zip(("label", "weight", "start", "end"), f)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) if f.name == "doc_id" else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id; n_words; of base phrases n_base (all places), first_word, last_word
    (null without any) and base_labels; labels (base and rules'); score, the weight of the strongest
    notice (0 without any); found, the rules' detections with offsets in the lower-cased text whose
    runs of ASCII white space are one space.

    Null and empty texts have no words, places or labels (empty strings). Repeated rows are judged
    each by itself. An empty table gives an empty result; further columns are ignored.
    """
    source = narrow(docs, doc_id=id_col, text=text_col)
    ddl = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"
    return source.mapInArrow(_scanner(to_arrow_schema(StructType.fromDDL(ddl))), ddl)
