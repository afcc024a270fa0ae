"""License scan by ordered signature rules.

Text is reduced to lower-case words (digits, a-z and everything beyond ASCII; all else parts words), joined by single
blanks. The signatures below, one regular expression each, stand in order of priority: wordings of notices and texts
first, then names with their versions, identifiers, bare names. A signature is tried only where one of its keywords
occurs in the document; most documents hold no keyword and are done after one look. Overlapping detections are resolved
in order of priority: one that lies inside a detection that stays, or holds one, is suppressed; among those of one
signature the first stays. Short names such as "asl" or "mpl" count only beside a word of licensing.

Four base phrases are counted separately, wherever their words stand.

Null or empty text has no words and score 0. Very long texts are read whole. Repeated rows and ids are scanned each for
itself; no rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, table, utf8

# The phrases and labels of the base count.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: What stands for often repeated parts of the patterns: a licence, a version with what may follow it, words of a grant.
PARTS = {
    "%l": "licen[cs]e",
    "%v": r"(?: version)?(?: v)? v?([0-9](?: [0-9])?)(?: or (?:any )?(?:later|newer)(?: version)?)?",
    "%g": "(?:(?:re)?licen[cs]ed|released|distributed|available|published|provided|covered|governed)(?: under| by| with)(?: the)?(?: terms of(?: the)?)?",
}

# Label ({} is the version found), keywords of which one is in every match, pattern, how sure a match is.
_RULES = (
    # Wordings of notices and texts.
    ("agpl", "affero", "free software foundation either version 3 of the gnu affero general public %l", 1.0),
    ("agpl-{}", "affero", "gnu affero general public %l as published by the free software foundation either%v of the %l", 1.0),
    ("lgpl-{}", "lesser", "gnu lesser general public %l as published by the free software foundation either%v of the %l", 1.0),
    ("lgpl-{}", "library", "gnu library general public %l as published by the free software foundation either%v of the %l", 1.0),
    ("gpl-{}", "gnu", "gnu general public %l as published by the free software foundation either%v of the %l", 1.0),
    ("gpl-{}", "gnu", "gnu general public %l as published by the free software foundation%v", 1.0),
    ("gpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu general public %l", 1.0),
    ("lgpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public %l", 1.0),
    ("agpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public %l", 1.0),
    ("gpl", "gnu", "see the gnu general public %l for more details", 1.0),
    ("lgpl", "lesser", "see the gnu lesser general public %l for more details", 1.0),
    ("agpl", "affero", "see the gnu affero general public %l for more details", 1.0),
    ("gpl", "gnu", "you should have received a copy of the gnu general public %l", 1.0),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public %l", 1.0),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public %l", 1.0),
    ("gpl", "copyleft", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gfdl-{}", "free documentation", "copy distribute and or modify this document under the terms of the gnu free documentation %l%v", 1.0),
    ("apache-{}", "apache", "licensed under the apache %l%v the %l you may not use this (?:file|software|work) except in compliance with the %l", 1.0),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the %l you may obtain a copy of the %l at", 0.9),
    ("apache-2.0", "as is basis", "distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.9),
    ("apache-1.1", "apache", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache", 1.0),
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit-0", "no attribution", "mit no attribution", 1.0),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1.0),
    ("0bsd", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose", 0.9),
    ("ntp", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{0,80} nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.8),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.8),
    ("bsd-patent", "patent", "redistribution and use .{0,120} no patent rights are granted", 0.8),
    ("mpl-{}", "mozilla", "this source code form is subject to the terms of the mozilla public %l%v", 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public %l version 1 1", 1.0),
    ("mpl-2.0", "incompatible with secondary", "this source code form is incompatible with secondary licenses", 1.0),
    ("mpl-2.0", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("epl-{}", "eclipse", "made available under the terms of the eclipse public %l%v", 1.0),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public %l", 1.0),
    ("cddl-{}", "common development", "subject to the terms of the common development and distribution %l%v", 1.0),
    ("cddl", "common development", "you may not use this file except in compliance with the common development and distribution %l", 1.0),
    ("cpl-{}", "common public", "made available under the terms of the common public %l%v", 1.0),
    ("zlib", "without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("libpng", "png reference", "this copy of the libpng notices is provided|the png reference library is supplied as is", 1.0),
    ("boost-1.0", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("boost-{}", "boost", "distributed under the boost software %l%v", 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to public %l", 1.0),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 1.0),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 1.0),
    ("beerware", "beer", "(?:the )?beer ?ware %l", 1.0),
    ("cc0-1.0", "no copyright", "to the extent possible under law .{0,120} waived all copyright and related or neighboring rights", 1.0),
    ("cc0-1.0", "waived all copyright", "waived all copyright and related or neighboring rights", 1.0),
    ("public-domain", "public domain", "(?:released|dedicated|placed|put) (?:in ?to|in|to) the public domain", 0.9),
    ("public-domain", "public domain", "(?:this|the) (?:work|file|software|code|text|document) is in the public domain", 0.9),
    ("public-domain", "public domain", "public domain dedication", 0.8),
    ("public-domain", "no copyright is claimed", "no copyright is claimed", 0.7),
    ("artistic-{}", "artistic", "under the terms of the artistic %l%v", 1.0),
    ("perl", "perl", "under the same terms as perl(?: itself)?", 1.0),
    ("python-2.0", "python software foundation", "this %l agreement is between the python software foundation", 1.0),
    ("php-3.01", "php", "this product includes php software freely available from", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1.0),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young", 1.0),
    ("w3c", "w3c", "this work is being provided by the copyright holders under the following %l", 0.8),
    ("unicode", "unicode", "permission is hereby granted .{0,120} unicode data files", 1.0),
    ("icu", "international business machines", "permission is hereby granted .{0,200} international business machines", 0.8),
    ("ofl-{}", "sil", "licensed under the sil open font %l%v", 1.0),
    ("ofl", "font software", "the font software may be modified altered or added to", 1.0),
    ("ncsa", "with the software without restriction", "deal with the software without restriction", 0.9),
    ("curl", "daniel stenberg", "permission to use copy modify and distribute .{0,160} daniel stenberg|copyright .{0,60}daniel stenberg", 0.8),
    ("json", "used for good", "the software shall be used for good not evil", 1.0),
    ("vim", "vim", "vim is charityware", 1.0),
    ("postgresql", "regents", "permission to use copy modify and distribute this software .{0,160} regents of the university", 0.8),
    ("eupl-{}", "eupl", "licensed under the eupl%v", 1.0),
    ("eupl", "european union", "licensed under the european union public %l", 1.0),
    ("ms-pl", "microsoft public", "this %l governs use of the accompanying software .{0,80} microsoft public %l", 1.0),
    ("bsl-{}", "business source", "business source %l%v", 1.0),
    ("sspl-{}", "server side public", "server side public %l%v", 1.0),
    ("commons-clause", "commons clause", "commons clause %l condition|the commons clause", 0.9),
    ("elastic-{}", "elastic", "elastic %l%v", 1.0),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited", 0.9),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.6),
    # Names with versions.
    ("agpl-{}", "affero", "gnu affero general public %l%v", 1.0),
    ("agpl-{}", "affero", "affero (?:general public %l|gpl)%v", 1.0),
    ("lgpl-{}", "lesser", "gnu lesser general public %l%v", 1.0),
    ("lgpl-{}", "library", "gnu library general public %l%v", 1.0),
    ("lgpl-{}", "lesser", "lesser (?:general public %l|gpl)%v", 1.0),
    ("gfdl-{}", "free documentation", "(?:gnu )?free documentation %l%v", 1.0),
    ("gpl-{}", "general public", "gnu general public %l%v", 1.0),
    ("gpl-{}", "gnu", "gnu public %l%v", 0.9),
    ("gpl-{}", "gnu", "gnu gpl%v", 1.0),
    ("apache-{}", "apache", "apache (?:software )?(?:public )?%l%v", 1.0),
    ("mpl-{}", "mozilla", "mozilla public %l%v", 1.0),
    ("epl-{}", "eclipse", "eclipse public %l%v", 1.0),
    ("edl-{}", "eclipse", "eclipse distribution %l%v", 1.0),
    ("eupl-{}", "european union", "european union public %l(?: eupl)?%v", 1.0),
    ("cddl-{}", "common development", "common development and distribution %l(?: cddl)?%v", 1.0),
    ("cpl-{}", "common public", "common public %l%v", 1.0),
    ("cpal-{}", "attribution", "common public attribution %l%v", 1.0),
    ("artistic-{}", "artistic", "artistic %l%v", 1.0),
    ("afl-{}", "academic", "academic free %l%v", 1.0),
    ("osl-{}", "open software", "open software %l%v", 1.0),
    ("boost-{}", "boost", "boost (?:software )?%l%v", 1.0),
    ("ofl-{}", "open font", "(?:sil )?open font %l%v", 1.0),
    ("odbl-{}", "open database", "(?:odc )?open database %l(?: odbl)?%v", 1.0),
    ("odc-by-{}", "open data commons", "open data commons attribution %l%v", 1.0),
    ("pddl-{}", "open data commons", "open data commons public domain dedication and %l%v", 1.0),
    ("php-{}", "php", "php %l%v", 1.0),
    ("python-{}", "python", "python (?:software foundation )?%l%v", 0.9),
    ("ruby", "ruby", "(?:under the|the) ruby %l", 0.9),
    ("zpl-{}", "zope", "zope public %l%v", 1.0),
    ("lppl-{}", "latex", "latex project public %l%v", 1.0),
    ("qpl-{}", "q public", "q public %l%v", 1.0),
    ("apsl-{}", "apple", "apple public source %l%v", 1.0),
    ("spl-{}", "sun public", "sun public %l%v", 1.0),
    ("npl-{}", "netscape", "netscape public %l%v", 1.0),
    ("ipl-{}", "ibm", "ibm public %l%v", 1.0),
    ("cecill-{}", "cecill", "cecill(?: free software)?(?: %l)?(?: agreement)?%v", 1.0),
    ("etalab-{}", "etalab", "(?:etalab )?licence ouverte(?: etalab)?%v", 1.0),
    ("ogl-{}", "open government", "open government %l%v", 1.0),
    ("openrail", "openrail", "(?:creativeml |bigscience )?open ?rail(?: [ms]{1,2})?(?: %l)?", 0.9),
    # Creative Commons, short and in full.
    ("cc-by-nc-nd-{}", "cc by", "cc by nc nd%v", 1.0),
    ("cc-by-nc-sa-{}", "cc by", "cc by nc sa%v", 1.0),
    ("cc-by-nc-{}", "cc by", "cc by nc%v", 1.0),
    ("cc-by-nd-{}", "cc by", "cc by nd%v", 1.0),
    ("cc-by-sa-{}", "cc by", "cc by sa%v", 1.0),
    ("cc-by-{}", "cc by", "cc by(?: %l)?%v", 1.0),
    ("cc-by-nc-nd-{}", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: %l)?(?: [0-9] [0-9]) (?:international|unported)|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: %l)?%v", 1.0),
    ("cc-by-nc-sa-{}", "creative commons", "creative commons attribution non ?commercial share ?alike(?: international)?(?: public)?(?: %l)?%v", 1.0),
    ("cc-by-nc-{}", "creative commons", "creative commons attribution non ?commercial(?: international)?(?: public)?(?: %l)?%v", 1.0),
    ("cc-by-nd-{}", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: international)?(?: public)?(?: %l)?%v", 1.0),
    ("cc-by-sa-{}", "creative commons", "creative commons attribution share ?alike(?: international)?(?: public)?(?: %l)?%v", 1.0),
    ("cc-by-{}", "creative commons", "creative commons attribution(?: international)?(?: public)?(?: %l)?%v", 1.0),
    ("cc0-{}", "cc0", "cc0%v", 1.0),
    ("cc0-{}", "creative commons", "creative commons (?:cc0|zero)%v", 1.0),
    ("cc-by-nc-nd", "cc by", "cc by nc nd", 0.9),
    ("cc-by-nc-sa", "cc by", "cc by nc sa", 0.9),
    ("cc-by-nc", "cc by", "cc by nc", 0.9),
    ("cc-by-nd", "cc by", "cc by nd", 0.9),
    ("cc-by-sa", "cc by", "cc by sa", 0.9),
    ("cc-by", "cc by", "cc by", 0.8),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike", 0.9),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", 0.9),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike", 0.9),
    ("cc-by", "creative commons", "creative commons attribution", 0.8),
    ("cc0", "creative commons", "creative commons zero", 0.9),
    # Identifiers behind the tag of a file, and classifiers of packages.
    ("gpl-{}", "spdx", "spdx %l identifier gpl v?([0-9](?: [0-9])?)(?: only| or later)?", 1.0),
    ("lgpl-{}", "spdx", "spdx %l identifier lgpl v?([0-9](?: [0-9])?)(?: only| or later)?", 1.0),
    ("agpl-{}", "spdx", "spdx %l identifier agpl v?([0-9](?: [0-9])?)(?: only| or later)?", 1.0),
    ("apache-{}", "spdx", "spdx %l identifier apache ([0-9] [0-9])", 1.0),
    ("mit", "spdx", "spdx %l identifier mit", 1.0),
    ("bsd-{}-clause", "spdx", "spdx %l identifier bsd ([0-9]) clause", 1.0),
    ("isc", "spdx", "spdx %l identifier isc", 1.0),
    ("zlib", "spdx", "spdx %l identifier zlib", 1.0),
    ("mpl-{}", "spdx", "spdx %l identifier mpl ([0-9] [0-9])", 1.0),
    ("epl-{}", "spdx", "spdx %l identifier epl ([0-9] [0-9])", 1.0),
    ("boost-{}", "spdx", "spdx %l identifier bsl ([0-9] [0-9])", 1.0),
    ("unlicense", "spdx", "spdx %l identifier unlicense", 1.0),
    ("0bsd", "spdx", "spdx %l identifier 0bsd", 1.0),
    ("gpl", "osi approved", "osi approved gnu general public %l", 1.0),
    ("mit", "osi approved", "osi approved mit %l", 1.0),
    ("bsd", "osi approved", "osi approved bsd %l", 1.0),
    ("apache", "osi approved", "osi approved apache software %l", 1.0),
    # Short names beside a word of licensing.
    ("agpl-{}", "agpl", "(?:gnu )?agpl(?: %l)?%v", 0.9),
    ("agpl-{}", "agplv", "agplv([0-9])", 1.0),
    ("lgpl-{}", "lgpl", "(?:gnu )?lgpl(?: %l)?%v", 0.9),
    ("lgpl-{}", "lgplv", "lgplv([0-9](?: [0-9])?)", 1.0),
    ("gpl-{}", "gpl", "gpl(?: %l)?%v", 0.9),
    ("gpl-{}", "gplv", "gplv([0-9])", 1.0),
    ("apache-{}", "asl", "%g asl%v|asl%v %l", 0.9),
    ("mpl-{}", "mpl", "%g mpl%v|mpl%v %l", 0.9),
    ("epl-{}", "epl", "%g epl%v|epl%v %l", 0.9),
    ("boost-{}", "bsl", "%g bsl%v|bsl%v %l", 0.8),
    ("cddl-{}", "cddl", "%g cddl%v|cddl%v %l", 0.9),
    ("bsd-{}-clause", "clause", "(?:bsd )?([0-9]) clause bsd(?: %l)?|bsd ([0-9]) clause(?: %l)?", 1.0),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified) bsd(?: %l| style)", 1.0),
    ("bsd-2-clause", "bsd", "(?:simplified|free) bsd(?: %l| style)", 1.0),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd(?: %l| style)", 1.0),
    # Bare names.
    ("agpl", "affero", "(?:gnu )?affero (?:general public %l|gpl)", 0.9),
    ("lgpl", "lesser", "(?:gnu )?lesser (?:general public %l|gpl)", 0.9),
    ("lgpl", "library", "gnu library general public %l", 0.9),
    ("gfdl", "free documentation", "gnu free documentation %l", 0.9),
    ("gpl", "gnu", "gnu (?:general public %l|gpl|public %l)", 0.9),
    ("gpl", "gpl", "(?:%g|the) gpl(?: %l)?|gpl %l", 0.8),
    ("lgpl", "lgpl", "(?:%g|the) lgpl(?: %l)?|lgpl %l", 0.8),
    ("agpl", "agpl", "(?:%g|the) agpl(?: %l)?|agpl %l", 0.8),
    ("apache", "apache", "apache (?:software )?(?:public )?%l", 0.8),
    ("mit", "mit", "mit(?: x11)?(?: style)? %l", 0.9),
    ("mit", "expat", "expat %l", 0.9),
    ("bsd", "bsd", "bsd(?: style)? %l", 0.8),
    ("mpl", "mozilla", "mozilla public %l", 0.9),
    ("epl", "eclipse", "eclipse public %l", 0.9),
    ("eupl", "european union", "european union public %l", 0.9),
    ("cddl", "common development", "common development and distribution %l", 0.9),
    ("isc", "isc", "isc %l", 0.9),
    ("zlib", "zlib", "zlib(?: libpng)? %l", 0.9),
    ("boost", "boost", "boost software %l", 0.9),
    ("artistic", "artistic", "artistic %l", 0.8),
    ("unlicense", "unlicense", "(?:the|%g) unlicense", 0.9),
    ("ofl", "open font", "(?:sil )?open font %l", 0.9),
    ("odbl", "open database", "open database %l", 0.9),
    ("ogl", "open government", "open government %l", 0.8),
)


class Signature(NamedTuple):
    """``words`` is a pattern over the reduced text, tried only where a keyword occurs; a lower ``rank`` wins."""

    rank: int
    label: str
    keyword: bytes
    words: re.Pattern
    sure: float


def _signatures() -> list[Signature]:
    out = []
    for k, (label, keyword, words, sure) in enumerate(_RULES):
        for name, part in PARTS.items():
            words = words.replace(name, part)
        out.append(Signature(k, label, keyword.encode(), re.compile(f" (?:{words})(?= )".encode()), sure))
    return out


SIGNATURES = _signatures()
KEYWORDS = tuple(sorted({s.keyword for s in SIGNATURES}))
#: A document without any of these has no keyword either: a cheaper first look.
GATE = re.compile(b"|".join(map(re.escape, sorted(KEYWORDS, key=len))))
_REDUCED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def reduced(text: bytes) -> list[bytes]:
    """The lower-case words of UTF-8 text."""
    return text.translate(_REDUCED).split()


def named(s: Signature, m: re.Match) -> str:
    """The label of a match: with the version that it names, if the label has one."""
    version = next((g.decode() for g in m.groups() if g), "")
    return s.label.replace("{}", version.replace(" ", ".")) if version else s.label.replace("-{}", "")


def detections(flat: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, label, how sure) over reduced text with a blank at either end, suppressed ones left out, by start."""
    if not GATE.search(flat):
        return []
    held = {k for k in KEYWORDS if k in flat}
    # What stays never lies inside another one that stays, so in order of starts the ends are in order too.
    kept, starts = [], []
    for s in SIGNATURES:
        if s.keyword not in held:
            continue
        new = []
        for m in s.words.finditer(flat):
            start, end = m.span()
            k = bisect_right(starts, start)
            inside = k > 0 and kept[k - 1][1] >= end
            holds = (k < len(kept) and kept[k][1] <= end) or (k > 0 and kept[k - 1][0] == start)
            if not inside and not holds:
                new.append((start, end, named(s, m), s.sure))
        if new:
            kept = sorted(kept + new)
            starts = [d[0] for d in kept]
    return kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one text."""
    words = reduced(text)
    flat = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        sought = f" {phrase} ".encode()
        at = flat.find(sought)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = flat.find(sought, at + 1)
    found = detections(flat)
    labels = base | {label for _, _, label, _ in found}
    sure = max([1.0 if base else 0.0, *(sure for _, _, _, sure in found)])
    count = lambda at: flat.count(b" ", 0, at)
    first, last = (count(min(places)), count(max(places))) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), sure


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(first word, words, label, score) of each detection in a text."""
    flat = b" " + b" ".join(reduced((text or "").encode())) + b" "
    return [(flat.count(b" ", 0, a), flat.count(b" ", a, b), label, sure) for a, b, label, sure in detections(flat)]


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def each(batches):
        claim("licenses")
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            rows = [scan(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
