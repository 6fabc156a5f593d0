"""Signature rules of the licence scan, in order.

Patterns are matched against a text's words, lower case, with single blanks between
and around them. A rule is only tried on texts that contain its gate, which every
match contains: its keyword, or what both spellings of it share. Of two detections, one inside the other, the one of lower priority goes; of equal priority
the shorter, then the later rule's.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Priorities: a bare name, a name with its version or identifier, a grant, the licence's own words.
NAME, VERSIONED, GRANT, TEXT = 0, 1, 2, 3
SCORES = (0.6, 0.8, 0.9, 1.0)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str

    @property
    def gate(self) -> str:
        """What every match of the pattern contains after a blank."""
        if (self.label, self.keyword) in GATES:
            return GATES[self.label, self.keyword]
        return self.keyword.removesuffix("se") if self.keyword.endswith("license") and "licen[cs]e" in self.pattern else self.keyword


#: Gates of rules whose keyword isn't part of every match.
GATES = {
    ("bsd-3-clause", "revised bsd"): "bsd licen",
    ("cc0-1.0", "creative commons"): "dedicated the work to the public domain",
    ("python-2.0", "python software foundation"): "psf hereby grants",
    ("ms-pl", "microsoft public license"): "this license governs use",
    ("proprietary", "may not be reproduced"): "be reproduced",
}


def _rules(priority: int, rows: str) -> list[Rule]:
    """One rule a line: label, keyword, pattern, with bars between; a pattern may have bars of its own."""
    cut = [[x.strip() for x in line.split("|", 2)] for line in rows.strip().splitlines()]
    return [Rule(label, priority, keyword, pattern) for label, keyword, pattern in cut]


#: The licences' own sentences.
TEXTS = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse or promote products | (?:neither the names? of|the names? of) (?:\S+ ){1,24}may (?:not )?be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
apache-2.0 | apache license | apache license version 2 0 january 2004
apache-2.0 | you may not use this file | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | distributed on an as is basis | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-2.0 | gnu general public license | gnu general public license version 2 june 1991
gpl-3.0 | gnu general public license | gnu general public license version 3 29 june 2007
gpl | free software you can redistribute | (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | published by the free software | gnu general public license as published by the free software foundation
gpl-2.0 | either version 2 | gnu general public license (?:\S+ ){0,8}either version 2 of the license
gpl-2.0-or-later | either version 2 | either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 | either version 3 of the license or at your option any later version
gpl | you should have received | you should have received a copy of the gnu general public license
lgpl | lesser general public license | (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | library general public license | (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu library general public license
lgpl-2.1 | lesser general public license | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lesser general public license | gnu lesser general public license version 3 29 june 2007
lgpl-2.1-or-later | either version 2 1 | either version 2 1 of the license or at your option any later version
lgpl | you should have received | you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3.0 | affero general public license | gnu affero general public license version 3 19 november 2007
agpl | affero general public license | (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl | you should have received | you should have received a copy of the gnu affero general public license
mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
artistic-2.0 | artistic license | the artistic license 2 0 (?:\S+ ){0,10}everyone is permitted to copy and distribute verbatim copies
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | you just do what | you just do what the \S+ you want to
zlib | altered source versions | altered source versions must be plainly marked as such
zlib | the origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | boost software license | boost software license version 1 0 august 17th 2003
bsl-1.0 | accompanying documentation covered | obtaining a copy of the software and accompanying documentation covered by this license
cc0-1.0 | creative commons | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | waiving all of his | by waiving all of his or her rights to the work worldwide under copyright law
ofl-1.1 | open font license | this font software is licensed under the sil open font license version 1 1
python-2.0 | python software foundation | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | openssl project | this product includes software developed by the openssl project
php-3.01 | php license | this source file is subject to version 3 01 of the php license
ncsa | deal with the software without | to deal with the software without restriction
postgresql | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license
curl | permission to use copy modify | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
proprietary | all rights reserved | confidential and proprietary (?:\S+ ){0,12}all rights reserved
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
x11 | except as contained in this notice | except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising
json | software shall be used for good | the software shall be used for good not evil
beerware | whatever you want with this stuff | you can do whatever you want with this stuff
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
freetype | freetype project | portions of this software are copyright (?:\S+ ){0,4}the freetype project
cpl-1.0 | common public license | made available under the terms of the common public license
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | w3c software notice | this work is being provided by the copyright holders under the w3c software notice and license
cecill | governed by the cecill | this software is governed by the cecill(?: \S+)? license under french law
eupl | licensed under the eupl | licensed under the eupl
lppl | latex project public license | it may be distributed and or modified under the conditions of the latex project public license
proprietary | may not be reproduced | no part of this (?:\S+ ){1,4}may be reproduced|may not be reproduced (?:\S+ ){0,10}without (?:\S+ ){0,4}written permission
"""

#: Statements that something is under a licence.
GRANTS = r"""
mit | licen | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?mit(?: x11)? licen[cs]e
mit | licen | licen[cs]e mit
bsd | bsd | (?:licensed|released|distributed|available|provided) under (?:the|a) (?:terms of the )?(?:\S+ ){0,3}bsd(?: style)? licen[cs]e
apache | apache | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?apache(?: software)? licen[cs]e
gpl | gpl | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?(?:gnu )?gpl
gpl | general public license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?gnu general public licen[cs]e
lgpl | lgpl | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?(?:gnu )?lgpl
lgpl | lesser general public license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?gnu lesser general public licen[cs]e
agpl | agpl | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?(?:gnu )?agpl
mpl | mozilla public license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?mozilla public licen[cs]e
epl | eclipse public license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?eclipse public licen[cs]e
isc | licen | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?isc licen[cs]e
zlib | zlib | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?zlib licen[cs]e
bsl-1.0 | boost software license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?boost software licen[cs]e
artistic | artistic license | (?:licensed|released|distributed|available|provided) under the (?:terms of the )?(?:perl )?artistic licen[cs]e
public-domain | public domain | (?:placed|released|dedicated|put) (?:\S+ ){0,3}(?:in|into|to) the public domain
public-domain | public domain | (?:this|the) (?:work|text|file|code|document|software) is in the public domain
cc-by | creative commons | (?:licensed|released|distributed|available|provided) under (?:a|the) (?:terms of the )?creative commons attribution
cc | creative commons | (?:licensed|released|distributed|available|provided) under (?:a|the) (?:terms of the )?creative commons
odbl | open database license | (?:licensed|released|distributed|available|provided|made available) under the open database licen[cs]e
proprietary | all rights reserved | copyright (?:\S+ ){0,10}all rights reserved
"""

#: Names with a number or an identifier.
VERSIONS = r"""
apache-2.0 | apache | apache(?: software)? licen[cs]e (?:v|ver|version)? ?2(?: 0)?
apache-2.0 | apache 2 | apache 2 0
apache-1.1 | apache | apache(?: software)? licen[cs]e (?:v|ver|version)? ?1 1
apache-1.0 | apache | apache(?: software)? licen[cs]e (?:v|ver|version)? ?1 0
bsd-2-clause | bsd 2 clause | bsd 2 clause
bsd-3-clause | bsd 3 clause | bsd 3 clause
bsd-4-clause | bsd 4 clause | bsd 4 clause
bsd-2-clause | simplified bsd | simplified bsd licen[cs]e
bsd-3-clause | new bsd | new bsd licen[cs]e
bsd-3-clause | revised bsd | (?:modified|revised) bsd licen[cs]e
bsd-2-clause | freebsd license | freebsd licen[cs]e
bsd-4-clause | original bsd | original bsd licen[cs]e
mpl-1.0 | mozilla public | mozilla public licen[cs]e (?:v|version)? ?1 0
mpl-1.1 | mozilla public | mozilla public licen[cs]e (?:v|version)? ?1 1
mpl-2.0 | mozilla public | mozilla public licen[cs]e (?:v|version)? ?2(?: 0)?
epl-1.0 | eclipse public | eclipse public licen[cs]e (?:v|version)? ?1(?: 0)?
epl-2.0 | eclipse public | eclipse public licen[cs]e (?:v|version)? ?2(?: 0)?
eupl-1.1 | european union public | european union public licen[cs]e (?:v|version)? ?1 1
eupl-1.2 | european union public | european union public licen[cs]e (?:v|version)? ?1 2
artistic-1.0 | artistic | artistic licen[cs]e (?:v|version)? ?1 0
artistic-2.0 | artistic | artistic licen[cs]e (?:v|version)? ?2 0
bsl-1.0 | boost software | boost software licen[cs]e (?:v|version)? ?1 0
busl-1.1 | business source | business source licen[cs]e (?:v|version)? ?1 1
sspl-1.0 | server side public | server side public licen[cs]e (?:v|version)? ?1
osl-3.0 | open software | open software licen[cs]e (?:v|version)? ?3 0
afl-3.0 | academic free | academic free licen[cs]e (?:v|version)? ?3 0
ofl-1.1 | open font | open font licen[cs]e (?:v|version)? ?1 1
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
ms-pl | microsoft public | microsoft public licen[cs]e
gfdl-1.2 | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version)? ?1 2
gfdl-1.3 | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version)? ?1 3
apsl-2.0 | apple public source | apple public source licen[cs]e (?:v|version)? ?2(?: 0)?
cecill-2.1 | cecill | cecill (?:v|version)? ?2 1
cpl-1.0 | common public | common public licen[cs]e (?:v|version)? ?1 0
ecl-2.0 | educational community | educational community licen[cs]e (?:v|version)? ?2 0
lppl-1.3c | latex project public | latex project public licen[cs]e (?:v|version)? ?1 3c
mulanpsl-2.0 | mulan psl | mulan psl v2
ncsa | uiuc | uiuc licen[cs]e
upl-1.0 | universal permissive | universal permissive licen[cs]e (?:v|version)? ?1 0
zpl-2.1 | zope public | zope public licen[cs]e (?:v|version)? ?2 1
odc-by-1.0 | odc by | odc by 1 0
odbl-1.0 | odbl | odbl 1 0
"""

#: Bare names.
NAMES = r"""
mit | mit license | mit licen[cs]e
mit | x11 license | x11 licen[cs]e
mit | expat license | expat licen[cs]e
bsd | bsd license | bsd licen[cs]e
apache | apache license | apache licen[cs]e
apache | apache software license | apache software licen[cs]e
gpl | gnu general public license | gnu general public licen[cs]e
gpl | gnu gpl | gnu gpl
lgpl | gnu lgpl | gnu lgpl
lgpl | lesser general public license | (?:gnu )?lesser general public licen[cs]e
lgpl | library general public license | (?:gnu )?library general public licen[cs]e
agpl | affero general public license | (?:gnu )?affero general public licen[cs]e
mpl | mozilla public license | mozilla public licen[cs]e
epl | eclipse public license | eclipse public licen[cs]e
cddl | common development and distribution | common development and distribution licen[cs]e
cpl | common public license | common public licen[cs]e
eupl | european union public | european union public licen[cs]e
isc | isc license | isc licen[cs]e
zlib | zlib license | zlib licen[cs]e
zlib | zlib libpng | zlib libpng licen[cs]e
bsl-1.0 | boost software license | boost software licen[cs]e
artistic | artistic license | artistic licen[cs]e
unlicense | the unlicense | the unlicense
wtfpl | wtfpl | wtfpl
ofl | open font license | (?:sil )?open font licen[cs]e
python | psf license | psf licen[cs]e
python | python software foundation license | python software foundation licen[cs]e
php | php license | php licen[cs]e
postgresql | postgresql license | postgresql licen[cs]e
openssl | openssl license | openssl licen[cs]e
ruby | ruby license | ruby licen[cs]e
vim | vim license | vim licen[cs]e
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source licen[cs]e
w3c | w3c software notice | w3c software notice and licen[cs]e
beerware | beer ware license | beer ware licen[cs]e
busl | business source license | business source licen[cs]e
sspl | server side public license | server side public licen[cs]e
elastic | elastic license | elastic licen[cs]e
gfdl | free documentation license | (?:gnu )?free documentation licen[cs]e
odbl | open database license | open database licen[cs]e
cc0 | cc0 | cc0
cc | creative commons | creative commons(?: licen[cs]e)?
apsl | apple public source | apple public source licen[cs]e
cecill | cecill | cecill(?: [bc])? licen[cs]e
ecl | educational community license | educational community licen[cs]e
ipl | ibm public license | ibm public licen[cs]e
lppl | latex project public | latex project public licen[cs]e
mulanpsl | mulan permissive software | mulan permissive software licen[cs]e
qpl | q public license | q public licen[cs]e
sleepycat | sleepycat license | sleepycat licen[cs]e
upl | universal permissive | universal permissive licen[cs]e
zpl | zope public license | zope public licen[cs]e
hpnd | historical permission notice | historical permission notice and disclaimer
public-domain | public domain | public domain dedication
proprietary | all rights reserved | all rights reserved
"""


def _versions_of(label: str, short: str, names: tuple[str, ...], versions: tuple[str, ...]) -> list[Rule]:
    """Rules for the numbered versions of one licence, by short name and in words, alone and with later versions."""
    found = []
    for v in versions:
        number = v.replace(".", " ").removesuffix(" 0") + ("(?: 0)?" if v.endswith(".0") else "")
        for keyword in (short, *names):
            plain = f"(?:gnu )?{keyword.replace('license', 'licen[cs]e')} (?:v|ver|version)? ?{number}"
            found.append(Rule(f"{label}-{v}", VERSIONED, keyword, plain))
            found.append(Rule(f"{label}-{v}-only", GRANT, keyword, f"{plain} only"))
            found.append(Rule(f"{label}-{v}-or-later", GRANT, keyword, f"{plain} (?:or|and) (?:\\S+ ){{0,4}}later"))
        found.append(Rule(f"{label}-{v}", VERSIONED, short, f"{short}v{v[0]}(?: {v[2:]})?" if not v.endswith(".0") else f"{short}v{v[0]}"))
    return found


def _commons() -> list[Rule]:
    """Rules for the Creative Commons licences: each kind, in letters and in words, alone and with each version."""
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?derivat(?:ives|ive works)"}
    found = []
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        letters, spelled = f"cc {' '.join(parts)}", "creative commons " + " ".join(words[p] for p in parts)
        for keyword, name in (("cc by", letters), ("creative commons", spelled)):
            found.append(Rule(f"cc-{kind}", NAME, keyword, name))
            found += [Rule(f"cc-{kind}-{v}", VERSIONED, keyword, f"{name} (?:\\S+ )?{v.replace('.', ' ')}") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    return found


RULES: tuple[Rule, ...] = (
    *_rules(TEXT, TEXTS),
    *_rules(GRANT, GRANTS),
    *_rules(VERSIONED, VERSIONS),
    *_versions_of("gpl", "gpl", ("general public license",), ("1.0", "2.0", "3.0")),
    *_versions_of("lgpl", "lgpl", ("lesser general public license", "library general public license"), ("2.0", "2.1", "3.0")),
    *_versions_of("agpl", "agpl", ("affero general public license",), ("1.0", "3.0")),
    *_commons(),
    *_rules(NAME, NAMES),
)

#: Strings one of which stands in every gate; a text with none of them is not looked at further.
STEMS = (
    "licen", "gpl", "apache", "bsd", "mozilla", "commons", "cc by", "cc0", "public", "permission", "redistribution", "reserved", "this file", "as is basis",
    "received", "either version", "software", "advertising", "anyone", "do what", "altered source", "accompanying", "waiving", "unauthorized",
    "reproduced", "psf hereby", "of the mpl", "open font", "microsoft", "free documentation", "wtfpl", "odc by", "odbl", "zlib", "endorse", "artistic", "copyright", "distribution", "academic", "openssl", "business",
    "except as contained", "good", "whatever", "jpeg", "freetype", "unicode", "cecill", "eupl", "latex project", "mulan", "uiuc", "zope", "universal permissive", "educational community", "historical permission",
)
if lost := [r.gate for r in RULES if not any(stem in r.gate for stem in STEMS)]:
    raise ValueError(f"gates without a stem: {lost}")
