"""The signature rules of the license scan.

A family has a label, the names by which the licence goes, its SPDX ids and its
address. A rule's keyword, which must stand in a text before its pattern is
tried, is the longest literal of the pattern. From each family come rules by
form: a line with the SPDX id, the licence's address,
a grant ("licensed under the ..."), a heading or full title, and the mere name.
Beside them stand sentences that are peculiar to a licence or a notice.
Lower priority numbers win; a form says how certain its rules are.
"""
from __future__ import annotations

import re

S = r"[\s,;:*#/\-\"'()]{1,8}"  # what may stand between words, line breaks and comment marks too
GAP = S.replace("{1,8}", "{0,8}")
V = r"(?:,?\s{0,3}\(?(?:version|v\.?)\s{0,3})?"

#: label, names (patterns), SPDX ids (patterns), address (pattern or None)
FAMILIES = [
    ("mit", ["mit", "mit/x11", "expat"], ["mit", "mit-0"], r"opensource\.org/licenses/mit"),
    ("apache", ["apache", f"apache{S}software"], [r"apache-2\.0", r"apache-1\.1"], r"apache\.org/licenses/license-2\.0"),
    ("gpl", [f"gnu{S}general{S}public", "gnu gpl", "gpl"], [r"gpl-[123]\.0(?:-only|-or-later|\+)?"], r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", [f"gnu{S}(?:lesser|library){S}general{S}public", "gnu lgpl", "lgpl"], [r"lgpl-[23]\.[01](?:-only|-or-later|\+)?"], r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", [f"gnu{S}affero{S}general{S}public", "gnu agpl", "agpl"], [r"agpl-[13]\.0(?:-only|-or-later|\+)?"], r"gnu\.org/licenses/agpl"),
    ("gfdl", [f"gnu{S}free{S}documentation", "gfdl"], [r"gfdl-1\.[123](?:-only|-or-later)?"], r"gnu\.org/licenses/fdl"),
    ("mpl", [f"mozilla{S}public", "mpl"], [r"mpl-[12]\.[01]"], r"mozilla\.org/mpl"),
    ("bsd-2-clause", [f"(?:2|two){S}clause{S}bsd", f"simplified{S}bsd", "freebsd"], ["bsd-2-clause"], r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", [f"(?:3|three){S}clause{S}bsd", f"(?:new|modified|revised){S}bsd"], ["bsd-3-clause"], r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", [f"(?:4|four){S}clause{S}bsd", f"original{S}bsd"], ["bsd-4-clause"], None),
    ("0bsd", [f"zero{S}clause{S}bsd", "0bsd", f"bsd{S}zero{S}clause"], ["0bsd"], r"opensource\.org/licenses/0bsd"),
    ("bsd", ["bsd"], ["bsd"], None),
    ("isc", ["isc"], ["isc"], r"opensource\.org/licenses/isc"),
    ("cc0", [f"cc0{S}1\\.0", f"creative{S}commons{S}zero", "cc0"], [r"cc0-1\.0"], r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", [f"cc{S}by{S}nc{S}nd", f"attribution{S}noncommercial{S}noderiv[a-z]*"], [r"cc-by-nc-nd-[1-4]\.0"], r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", [f"cc{S}by{S}nc{S}sa", f"attribution{S}noncommercial{S}sharealike"], [r"cc-by-nc-sa-[1-4]\.0"], r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", [f"cc{S}by{S}nc", f"attribution{S}noncommercial"], [r"cc-by-nc-[1-4]\.0"], r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", [f"cc{S}by{S}nd", f"attribution{S}noderiv[a-z]*"], [r"cc-by-nd-[1-4]\.0"], r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", [f"cc{S}by{S}sa", f"attribution{S}sharealike"], [r"cc-by-sa-[1-4]\.0"], r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", [f"cc{S}by", f"creative{S}commons{S}attribution"], [r"cc-by-[1-4]\.0"], r"creativecommons\.org/licenses/by/"),
    ("unlicense", [f"the{S}unlicense", "unlicense"], ["unlicense"], r"unlicense\.org"),
    ("wtfpl", ["wtfpl"], ["wtfpl"], r"wtfpl\.net"),
    ("zlib", ["zlib", "zlib/libpng"], ["zlib", "zlib-acknowledgement"], r"opensource\.org/licenses/zlib"),
    ("boost", [f"boost{S}software", "bsl"], [r"bsl-1\.0"], r"boost\.org/license_1_0"),
    ("epl", [f"eclipse{S}public", "epl"], [r"epl-[12]\.0"], r"eclipse\.org/legal/epl"),
    ("edl", [f"eclipse{S}distribution", "edl"], [], r"eclipse\.org/org/documents/edl"),
    ("cddl", [f"common{S}development{S}and{S}distribution", "cddl"], [r"cddl-1\.[01]"], r"opensource\.org/licenses/cddl"),
    ("cpl", [f"common{S}public", "cpl"], [r"cpl-1\.0"], None),
    ("ipl", [f"ibm{S}public", "ipl"], [r"ipl-1\.0"], None),
    ("artistic", ["artistic", f"perl{S}artistic"], [r"artistic-[12]\.0"], r"opensource\.org/licenses/artistic"),
    ("python", [f"python{S}software{S}foundation", "psf"], [r"psf-2\.0", r"python-2\.0"], r"python\.org/psf/license"),
    ("php", ["php"], [r"php-3\.0[01]?"], r"php\.net/license"),
    ("ruby", ["ruby"], ["ruby"], None),
    ("openssl", ["openssl"], ["openssl"], r"openssl\.org/source/license"),
    ("ofl", [f"sil{S}open{S}font", "ofl"], [r"ofl-1\.[01]"], r"scripts\.sil\.org/ofl"),
    ("odbl", [f"open{S}database", "odbl"], [r"odbl-1\.0"], r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", [f"open{S}data{S}commons{S}attribution", "odc-by"], [r"odc-by-1\.0"], r"opendatacommons\.org/licenses/by"),
    ("pddl", [f"public{S}domain{S}dedication{S}and", "pddl"], [r"pddl-1\.0"], r"opendatacommons\.org/licenses/pddl"),
    ("eupl", [f"european{S}union{S}public", "eupl"], [r"eupl-1\.[012]"], r"joinup\.ec\.europa\.eu"),
    ("cecill", ["cecill", "cecill-[abc]"], [r"cecill-(?:[abc]|[12]\.[01])"], r"cecill\.info"),
    ("ms-pl", [f"microsoft{S}public", "ms-pl"], ["ms-pl"], None),
    ("ms-rl", [f"microsoft{S}reciprocal", "ms-rl"], ["ms-rl"], None),
    ("osl", [f"open{S}software", "osl"], [r"osl-[123]\.[01]"], r"opensource\.org/licenses/osl"),
    ("afl", [f"academic{S}free", "afl"], [r"afl-[123]\.[012]"], r"opensource\.org/licenses/afl"),
    ("qpl", [f"q{S}public", "qpl"], [r"qpl-1\.0"], None),
    ("sleepycat", ["sleepycat"], ["sleepycat"], None),
    ("postgresql", ["postgresql"], ["postgresql"], r"postgresql\.org/about/licence"),
    ("ncsa", [f"university{S}of{S}illinois/ncsa", "ncsa"], ["ncsa"], r"opensource\.org/licenses/ncsa"),
    ("w3c", ["w3c", f"w3c{S}software"], ["w3c"], r"w3\.org/consortium/legal"),
    ("x11", ["x11"], ["x11"], None),
    ("sspl", [f"server{S}side{S}public", "sspl"], [r"sspl-1\.0"], r"mongodb\.com/licensing/server-side"),
    ("busl", [f"business{S}source", "busl"], [r"busl-1\.1"], r"mariadb\.com/bsl"),
    ("elastic", ["elastic"], [r"elastic-2\.0"], r"elastic\.co/licensing/elastic-license"),
    ("hippocratic", ["hippocratic"], [r"hippocratic-2\.1"], r"firstdonoharm\.dev"),
    ("json", ["json"], ["json"], r"json\.org/license"),
    ("vim", ["vim"], ["vim"], None),
    ("beerware", [f"beer{S}ware", "beerware"], ["beerware"], None),
    ("llama", [f"llama{S}[23](?:\\.[0-9])?{S}community", "llama"], [], r"llama\.meta\.com"),
    ("openrail", ["(?:bigscience-)?openrail(?:-m|\\+\\+)?", f"responsible{S}ai"], ["openrail", "openrail-m"], None),
    ("mulan", [f"mulan{S}(?:permissive{S}software|psl)"], [r"mulanpsl-[12]\.0"], r"license\.coscl\.org\.cn"),
]
#: Sentences of licences and notices: label, words (patterns; what stands between them is S), certainty.
SENTENCES = [
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", r"the software is provided .?as is.? without warranty of any kind, express or implied", 0.9),
    ("boost", "permission is hereby granted, free of charge, to any person or organization obtaining a copy", 1.0),
    ("ncsa", "deal with the software without restriction, including without limitation", 1.0),
    ("ncsa", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers", 0.95),
    ("bsd", "redistribution and use in source and binary forms", 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice", 0.85),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 1.0),
    ("isc", r"permission to use, copy, modify, (?:and|and/or) distribute this software for any purpose with or without fee", 0.95),
    ("isc", "the author disclaims all warranties with regard to this software", 0.9),
    ("postgresql", "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee", 1.0),
    ("x11", "shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software", 0.9),
    ("apache", "you may not use this file except in compliance with the license", 0.9),
    ("apache", r"distributed under the license is distributed on an .?as is.? basis", 0.9),
    ("apache", "this product includes software developed by the apache software foundation", 0.95),
    ("apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 1.0),
    ("openssl", "this product includes software developed by the openssl project", 1.0),
    ("php", r"products derived from this software may not be called .?php", 1.0),
    ("gpl", "this program is free software you can redistribute it", 0.9),
    ("gpl", "you should have received a copy of the gnu general public license", 0.95),
    ("gpl", r"either version [123] of the license, or \(at your option\) any later version", 0.8),
    ("lgpl", "this library is free software you can redistribute it", 0.95),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", 1.0),
    ("agpl", "you should have received a copy of the gnu affero general public license", 1.0),
    ("agpl", "interacting with it remotely through a computer network", 0.7),
    ("gfdl", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation", 1.0),
    ("mpl", "this source code form is subject to the terms of the mozilla public", 1.0),
    ("mpl", "if a copy of the mpl was not distributed with this file", 1.0),
    ("mpl", r"the contents of this file are subject to the (?:mozilla|netscape) public license", 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public", 1.0),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution", 1.0),
    ("zlib", r"this software is provided .?as is.? without any express or implied warranty", 0.9),
    ("zlib", "altered source versions must be plainly marked as such", 1.0),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", 1.0),
    ("wtfpl", "you just do what the fuck you want to", 1.0),
    ("beerware", "you can buy me a beer in return", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", "copyright holder maintains some semblance of artistic control", 0.95),
    ("python", "psf is making python available to licensee", 1.0),
    ("python", "psf hereby grants licensee a nonexclusive, royalty-free, world-wide license", 1.0),
    ("json", "the software shall be used for good, not evil", 1.0),
    ("vim", r"vim is (?:charityware|free software)", 0.9),
    ("ofl", "cannot be released under any other type of license", 0.8),
    ("ofl", "with reserved font name", 0.9),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license", 1.0),
    ("cc0", r"to the extent possible under law, [^.\n]{1,80}has waived all copyright", 1.0),
    ("cc0", "waived all copyright and related or neighboring rights", 0.95),
    ("cc-by", "this work is licensed under a creative commons attribution", 0.9),
    ("cc-by-sa", r"creative commons attribution share ?alike", 0.95),
    ("cc-by-nc", r"creative commons attribution non ?commercial", 0.95),
    ("cc-by-nd", r"creative commons attribution no ?deriv[a-z]*", 0.95),
    ("w3c", "w3c software notice and license", 1.0),
    ("sleepycat", "accompanying software that uses the db software", 1.0),
    ("sspl", "the service source code under the terms of this license", 0.8),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("busl", "the licensed work will be made available under the change license", 0.9),
    ("llama", r"built with (?:meta )?llama", 0.7),
    ("openrail", "use restrictions as referenced in paragraph", 0.7),
    ("proprietary", "all rights reserved", 0.5),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution)", 0.6),
    ("proprietary", "proprietary and confidential", 0.7),
    ("proprietary", "confidential and proprietary", 0.7),
    ("proprietary", "may not be reproduced or transmitted in any form", 0.7),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", r"(?:is|are) in the public domain", 0.6),
    ("public-domain", "no rights reserved", 0.6),
    ("public-domain", r"work of the (?:united states|u\.s\.) government", 0.7),
    ("copyright", r"copyright ?(?:\(c\) ?|© ?)?(?:19|20)[0-9]{2}", 0.4),
]
START, STOP = r"(?<![0-9a-z\x{80}-\x{10FFFF}])", r"(?![0-9a-z\x{80}-\x{10FFFF}])"
NUMBER = rf"{V}\s{{0,3}}[0-9](?:\.[0-9])?"


def literals(pattern: str) -> list[str]:
    """The runs of letters and digits that every match of the pattern holds, the longest first."""
    plain = pattern.replace(S, " ").replace(GAP, " ")
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)[?*+]?(?:\{[^}]*\})?", " ", plain)) != plain:
        plain = shorter
    plain = re.sub(r"\[[^]]*\][?*+]?(?:\{[^}]*\})?|\\s(?:\{[^}]*\})?|\\", " ", plain)
    return sorted(re.findall("[a-z0-9]+", plain), key=len, reverse=True)


def keyword(pattern: str) -> str:
    return literals(pattern)[0]


def sentences() -> list[tuple[str, str, float]]:
    """SENTENCES as (label, pattern, certainty): words part at S, an optional space is one that may also be missing."""
    return [(label, re.sub(r",? (\?)?", lambda m: GAP if m[1] else S, words), certainty) for label, words, certainty in SENTENCES]


def stems() -> dict[str, set[str]]:
    """Of each sentence its longest word, and what stands beside it: each match of a sentence has both words of one of these pairs, or the one word alone ("")."""
    out: dict[str, set[str]] = {}
    for _, pattern, _ in sentences():
        first, *rest = literals(pattern)
        out.setdefault(first, set()).add(next((w for w in rest if w != first), ""))
    return out


def signatures() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, pattern, label, certainty), in order of priority."""
    rules = []
    for label, names, ids, address in FAMILIES:
        for one in ids:
            rules.append((keyword(one), rf"spdx-license-identifier\s{{0,3}}:\s{{0,3}}{one}", label, 1.0))
            rules.append((keyword(one), rf"licen[sc]e[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?{one}", label, 0.9))
        if address:
            rules.append((keyword(address), address, label, 0.95))
        for name in names:
            grant = r"(?:licensed|released|distributed|available|provided)\s{1,3}under\s{1,3}(?:the\s{1,3})?(?:terms\s{1,3}of\s{1,3}(?:the\s{1,3})?)?"
            rules.append((keyword(name), rf"{grant}{name}(?:{S}licen[sc]e)?(?:{NUMBER})?", label, 0.85))
            rules.append((keyword(name), rf"{name}{S}licen[sc]e(?:{NUMBER})?", label, 0.8))
            if label.startswith("cc"):
                rules.append((keyword(name), rf"{name}\s{{1,3}}[1-4]\.0", label, 0.75))
    rules += [(keyword(pattern), pattern, label, certainty) for label, pattern, certainty in sentences()]
    rules.sort(key=lambda r: -r[3])  # stable: families in their order
    return [(i, word, f"(?i){START}(?:{pattern}){STOP}", label, certainty) for i, (word, pattern, label, certainty) in enumerate(rules)]
