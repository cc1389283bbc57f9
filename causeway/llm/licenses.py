"""Licence scan: ordered signature rules over the normalised words of a text.

A text is lower-cased (A-Z only) and reduced to its words joined by single blanks.  Each
rule is a hand-written regular expression on that form, gated by a keyword that every
match contains: the expression runs only where the keyword occurs.  Rules stand in order of priority; a
detection lying inside the interval of a kept detection of higher priority is
suppressed.  The three base phrases come first and are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import map_rows, read, text_of

# Fixed values of the contract: phrase -> label.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label ; strength ; keyword ; expression over the normalised words, by falling priority.
# Full notices come first, then names with a version, names without, and tags.
RULES = r"""
mit ; 1.0 ; permission is hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 ; 1.0 ; permission is hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
apache-2 ; 1.0 ; licensed under the apache ; licensed under the apache license version 2(?: 0)? the license you may not use this (?:file|work|document) except in compliance
apache-2 ; 1.0 ; apache org ; (?:https? )?www apache org licenses license 2 0(?: html| txt)?
apache-1.1 ; 1.0 ; developed by the apache ; this product includes software developed by the apache (?:group|software foundation)
bsd-3-clause ; 1.0 ; neither the name ; neither the names? of .{1,120}nor the names of (?:its|the|their) contributors may be used to endorse or promote
bsd-4-clause ; 1.0 ; all advertising materials ; all advertising materials mentioning features or use of this software must display
bsd-2-clause ; 1.0 ; and use in source ; redistributions? and use in source and binary forms with or without modification are permitted
bsd-0-clause ; 1.0 ; permission to use ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc ; 1.0 ; permission to use ; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
gpl-3 ; 1.0 ; general public license ; (?:either )?version 3 of the (?:gnu )?general public license
gpl-3 ; 1.0 ; general public license ; terms of the gnu general public license as published by the free software foundation (?:either )?version 3
gpl-2 ; 1.0 ; general public license ; terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-2 ; 1.0 ; general public license ; (?:either )?version 2 of the (?:gnu )?general public license
gpl-1 ; 1.0 ; general public license ; terms of the gnu general public license as published by the free software foundation (?:either )?version 1
lgpl-3 ; 1.0 ; lesser general public ; terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-2.1 ; 1.0 ; lesser general public ; terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-2 ; 1.0 ; library general public ; terms of the gnu library general public license as published by the free software foundation
agpl-3 ; 1.0 ; affero general public ; terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
fdl-1.3 ; 1.0 ; free documentation license ; terms of the gnu free documentation license version 1 3
fdl-1.2 ; 1.0 ; free documentation license ; terms of the gnu free documentation license version 1 2
mpl-2 ; 1.0 ; mozilla public license ; this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2(?: 0)?
mpl-1.1 ; 1.0 ; mozilla public license ; the contents of this file are subject to the mozilla public license version 1 1
mpl-1 ; 1.0 ; mozilla public license ; the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 ; 1.0 ; netscape public license ; the contents of this file are subject to the netscape public license version 1 1
epl-2 ; 1.0 ; eclipse public license ; made available under the terms of the eclipse public license (?:v|version )?2(?: 0)?
epl-1 ; 1.0 ; eclipse public license ; made available under the terms of the eclipse public license (?:v|version )?1(?: 0)?
cddl-1 ; 1.0 ; common development and distribution ; subject to the terms of the common development and distribution license
cpl-1 ; 1.0 ; common public license ; made available under the terms of the common public license (?:v|version )?1(?: 0)?
ms-pl ; 1.0 ; microsoft public license ; subject to the microsoft public license
ms-rl ; 1.0 ; microsoft reciprocal license ; subject to the microsoft reciprocal license
boost-1 ; 1.0 ; boost software license ; distributed under the boost software license version 1 0
zlib ; 1.0 ; altered source versions ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng ; 1.0 ; png reference library ; the png reference library is supplied as is
openssl ; 1.0 ; openssl toolkit ; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay ; 1.0 ; eric young ; this product includes cryptographic software written by eric young
php-3 ; 1.0 ; php license ; this source file is subject to version 3(?: 0\d?)? of the php license
python-2 ; 1.0 ; python software foundation ; this license agreement is between the python software foundation psf
unlicense ; 1.0 ; free and unencumbered ; this is free and unencumbered software released into the public domain
wtfpl ; 1.0 ; do what the fuck ; do what the fuck you want to public license
cc0-1 ; 1.0 ; extent possible under law ; to the extent possible under law .{1,120}waived all copyright and related or neighbou?ring rights
cc0-1 ; 1.0 ; publicdomain ; creativecommons org publicdomain zero 1 0
public-domain ; 1.0 ; publicdomain ; creativecommons org publicdomain mark 1 0
cc-by-nc-nd ; 1.0 ; creativecommons ; creativecommons org licenses by nc nd(?: \d 0)?
cc-by-nc-sa ; 1.0 ; creativecommons ; creativecommons org licenses by nc sa(?: \d 0)?
cc-by-nc ; 1.0 ; creativecommons ; creativecommons org licenses by nc(?: \d 0)?
cc-by-nd ; 1.0 ; creativecommons ; creativecommons org licenses by nd(?: \d 0)?
cc-by-sa ; 1.0 ; creativecommons ; creativecommons org licenses by sa(?: \d 0)?
cc-by ; 1.0 ; creativecommons ; creativecommons org licenses by(?: \d 0)?
odbl-1 ; 1.0 ; opendatacommons ; opendatacommons org licenses odbl(?: 1 0)?
odc-by-1 ; 1.0 ; opendatacommons ; opendatacommons org licenses by(?: 1 0)?
pddl-1 ; 1.0 ; opendatacommons ; opendatacommons org licenses pddl(?: 1 0)?
ofl-1.1 ; 1.0 ; sil open font ; licensed under the sil open font license version 1 1
artistic-2 ; 1.0 ; artistic license ; (?:under|of) the (?:terms of the )?artistic license (?:version )?2(?: 0)?
perl ; 1.0 ; same terms as perl ; under the same terms as perl(?: itself)?
ruby ; 1.0 ; ruby s ; (?:under the same terms as|under) ruby s license
ofl-1 ; 1.0 ; sil open font ; licensed under the sil open font license version 1 0
jpeg-group ; 1.0 ; independent jpeg group ; this software is based in part on the work of the independent jpeg group
curl ; 1.0 ; permission to use ; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
x11 ; 1.0 ; x consortium ; except as contained in this notice the name of the x consortium shall not be used
ntp ; 1.0 ; permission to use ; permission to use copy modify and distribute this software and its documentation for any purpose
hpnd ; 1.0 ; permission to use ; permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
proprietary ; 1.0 ; proprietary ; (?:this (?:file|document|software) is|contains?) (?:the )?(?:confidential and )?proprietary (?:information|material|to)
proprietary ; 1.0 ; via any medium ; unauthori[sz]ed copying of this (?:file|document|software) via any medium is strictly prohibited
no-ai-training ; 1.0 ; train ; may not be used (?:to train|for (?:the )?training(?: of)?) (?:machine learning|artificial intelligence|ai|language)(?: models?| systems?)?
no-derivatives ; 0.9 ; derivative ; no derivative works (?:are|is) (?:permitted|allowed)
non-commercial ; 0.9 ; commercial ; for (?:personal and )?non commercial use only
all-rights-reserved ; 0.9 ; all rights reserved ; copyright (?:c )?(?:\d{4} )?.{1,80}all rights reserved
apache-2 ; 0.9 ; apache ; apache (?:software )?license (?:v|version )?2(?: 0)?
apache-1.1 ; 0.9 ; apache ; apache (?:software )?license (?:v|version )?1 1
apache-1 ; 0.9 ; apache ; apache (?:software )?license (?:v|version )?1 0
mit ; 0.9 ; mit ; (?:the )?mit licen[sc]ed?(?: mit)?
mit ; 0.9 ; mit ; (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?mit
mit ; 0.9 ; expat ; (?:the )?expat licen[sc]e
x11 ; 0.9 ; x11 ; (?:the )?x11 licen[sc]e
gpl-3 ; 0.9 ; general public license ; gnu general public license (?:v|version )?3(?: 0)?
gpl-2 ; 0.9 ; general public license ; gnu general public license (?:v|version )?2(?: 0)?
gpl-1 ; 0.9 ; general public license ; gnu general public license (?:v|version )?1(?: 0)?
lgpl-3 ; 0.9 ; lesser general public ; gnu lesser general public license (?:v|version )?3(?: 0)?
lgpl-2.1 ; 0.9 ; lesser general public ; gnu lesser general public license (?:v|version )?2 1
lgpl-2 ; 0.9 ; library general public ; gnu library general public license (?:v|version )?2(?: 0)?
agpl-3 ; 0.9 ; affero general public ; gnu affero general public license (?:v|version )?3(?: 0)?
agpl-1 ; 0.9 ; affero general public ; affero general public license (?:v|version )?1(?: 0)?
fdl-1.3 ; 0.9 ; free documentation license ; gnu free documentation license (?:v|version )?1 3
fdl-1.2 ; 0.9 ; free documentation license ; gnu free documentation license (?:v|version )?1 2
fdl-1.1 ; 0.9 ; free documentation license ; gnu free documentation license (?:v|version )?1 1
bsd-4-clause ; 0.9 ; bsd ; (?:4|four) clause (?:original )?bsd|(?:original|old) bsd licen[sc]e|bsd 4 clause
bsd-3-clause ; 0.9 ; bsd ; (?:3|three) clause bsd|(?:new|modified|revised) bsd licen[sc]e|bsd 3 clause
bsd-2-clause ; 0.9 ; bsd ; (?:2|two) clause bsd|(?:simplified|free) bsd licen[sc]e|bsd 2 clause
bsd-0-clause ; 0.9 ; bsd ; (?:0|zero) clause bsd|bsd zero clause|0bsd
bsd-1-clause ; 0.9 ; bsd ; (?:1|one) clause bsd|bsd 1 clause
mpl-2 ; 0.9 ; mozilla public ; mozilla public license (?:v|version )?2(?: 0)?
mpl-1.1 ; 0.9 ; mozilla public ; mozilla public license (?:v|version )?1 1
mpl-1 ; 0.9 ; mozilla public ; mozilla public license (?:v|version )?1 0
npl-1.1 ; 0.9 ; netscape public ; netscape public license (?:v|version )?1 1
npl-1 ; 0.9 ; netscape public ; netscape public license (?:v|version )?1 0
epl-2 ; 0.9 ; eclipse public ; eclipse public license (?:v|version )?2(?: 0)?
epl-1 ; 0.9 ; eclipse public ; eclipse public license (?:v|version )?1(?: 0)?
edl-1 ; 0.9 ; eclipse distribution ; eclipse distribution license (?:v|version )?1(?: 0)?
eupl-1.2 ; 0.9 ; european union public ; european union public licen[sc]e (?:v|version )?1 2
eupl-1.1 ; 0.9 ; european union public ; european union public licen[sc]e (?:v|version )?1 1
eupl-1 ; 0.9 ; european union public ; european union public licen[sc]e (?:v|version )?1 0
cddl-1.1 ; 0.9 ; common development and distribution ; common development and distribution license (?:cddl )?(?:v|version )?1 1
cddl-1 ; 0.9 ; common development and distribution ; common development and distribution license (?:cddl )?(?:v|version )?1 0
cecill-2.1 ; 0.9 ; cecill ; cecill (?:free software licen[sc]e agreement )?(?:v|version )?2 1
cecill-2 ; 0.9 ; cecill ; cecill (?:free software licen[sc]e agreement )?(?:v|version )?2 0
cecill-b ; 0.9 ; cecill ; cecill b(?: licen[sc]e)?
cecill-c ; 0.9 ; cecill ; cecill c(?: licen[sc]e)?
osl-3 ; 0.9 ; open software license ; open software license (?:v|version )?3(?: 0)?
osl-2 ; 0.9 ; open software license ; open software license (?:v|version )?2(?: \d)?
afl-3 ; 0.9 ; academic free license ; academic free license (?:v|version )?3(?: 0)?
afl-2 ; 0.9 ; academic free license ; academic free license (?:v|version )?2(?: \d)?
artistic-2 ; 0.9 ; artistic license ; artistic license (?:v|version )?2(?: 0)?
artistic-1 ; 0.9 ; artistic license ; artistic license (?:v|version )?1(?: 0)?
boost-1 ; 0.9 ; boost software ; boost software license(?: (?:v|version )?1(?: 0)?)?
zpl-2 ; 0.9 ; zope public ; zope public license (?:v|version )?2(?: \d)?
qpl-1 ; 0.9 ; q public license ; (?:the )?q public license(?: (?:v|version )?1 0)?
ipl-1 ; 0.9 ; ibm public ; ibm public license(?: (?:v|version )?1 0)?
spl-1 ; 0.9 ; sun public ; sun public license(?: (?:v|version )?1 0)?
upl-1 ; 0.9 ; universal permissive ; universal permissive license(?: (?:v|version )?1 0)?
cpl-1 ; 0.9 ; common public license ; common public license(?: (?:v|version )?1 0)?
cpal-1 ; 0.9 ; common public attribution ; common public attribution license(?: (?:v|version )?1 0)?
apsl-2 ; 0.9 ; apple public source ; apple public source license (?:v|version )?2(?: 0)?
apsl-1 ; 0.9 ; apple public source ; apple public source license (?:v|version )?1(?: \d)?
rpl-1.5 ; 0.9 ; reciprocal public ; reciprocal public license(?: (?:v|version )?1 5)?
nasa-1.3 ; 0.9 ; nasa open source ; nasa open source agreement(?: (?:v|version )?1 3)?
ncsa ; 0.9 ; university of illinois ; university of illinois (?:ncsa )?open source license
ecl-2 ; 0.9 ; educational community ; educational community license(?: (?:v|version )?2 0)?
blueoak-1 ; 0.9 ; blue oak ; blue oak model license(?: 1 0 0)?
mulan-2 ; 0.9 ; mulan ; mulan (?:psl|permissive software license)(?: v(?:ersion )?2)?
postgresql ; 0.9 ; postgresql ; (?:the )?postgresql licen[sc]e
openldap-2.8 ; 0.9 ; openldap ; openldap public license(?: (?:v|version )?2 8)?
vim ; 0.9 ; vim ; (?:the )?vim licen[sc]e
ms-pl ; 0.9 ; microsoft public ; microsoft public license(?: ms pl)?
ms-rl ; 0.9 ; microsoft reciprocal ; microsoft reciprocal license(?: ms rl)?
sspl-1 ; 0.9 ; server side public ; server side public license(?: (?:v|version )?1)?
bsl-1.1 ; 0.9 ; business source ; business source license(?: (?:v|version )?1 1)?
elastic-2 ; 0.9 ; elastic license ; elastic license(?: (?:v|version )?2(?: 0)?)?
commons-clause ; 0.9 ; commons clause ; commons clause (?:license|licence|condition|restriction)
polyform-nc-1 ; 0.9 ; polyform ; polyform noncommercial license(?: 1 0 0)?
polyform-sb-1 ; 0.9 ; polyform ; polyform small business license(?: 1 0 0)?
prosperity-3 ; 0.9 ; prosperity public ; prosperity public license(?: 3 0 0)?
parity-7 ; 0.9 ; parity public ; parity public license(?: 7 0 0)?
hippocratic-3 ; 0.9 ; hippocratic ; hippocratic license(?: (?:v|version )?\d(?: \d)?)?
openrail-m ; 0.9 ; openrail ; (?:creativeml |bigscience |bigcode )?openrail(?: m| plus plus m)?(?: license)?
rail ; 0.9 ; responsible ai ; responsible ai licen[sc]es?
llama-community ; 0.9 ; community license ; llama (?:\d (?:\d )?)?community license(?: agreement)?
gemma-terms ; 0.9 ; gemma ; gemma terms of use
cc-by-nc-nd ; 0.9 ; attribution ; attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \d 0)?
cc-by-nc-sa ; 0.9 ; attribution ; attribution non ?commercial share ?alike(?: \d 0)?
cc-by-nc ; 0.9 ; attribution ; attribution non ?commercial(?: \d 0)?
cc-by-nd ; 0.9 ; attribution ; attribution no ?deriv(?:ative)?s?(?: works)?(?: \d 0)?
cc-by-sa ; 0.9 ; attribution ; attribution share ?alike(?: \d 0)?
cc-by ; 0.9 ; creative commons ; creative commons attribution(?: \d 0)?
cc0-1 ; 0.9 ; cc0 ; cc0(?: 1 0)?(?: universal)?
cc0-1 ; 0.9 ; creative commons ; creative commons (?:cc ?0|zero)(?: 1 0)?
cc-by-nc-nd ; 0.9 ; cc by nc nd ; cc by nc nd(?: \d 0)?
cc-by-nc-sa ; 0.9 ; cc by nc sa ; cc by nc sa(?: \d 0)?
cc-by-nd ; 0.9 ; cc by nd ; cc by nd(?: \d 0)?
cc-by-sa ; 0.9 ; cc by sa ; cc by sa(?: \d 0)?
cc-by ; 0.8 ; cc by ; cc by (?:\d 0|licen[sc]ed?|international)
ofl-1.1 ; 0.9 ; open font license ; (?:sil )?open font license(?: (?:v|version )?1 1)?
ubuntu-font-1 ; 0.9 ; ubuntu font ; ubuntu font licen[sc]e(?: (?:v|version )?1 0)?
bitstream-vera ; 0.9 ; bitstream vera ; bitstream vera (?:font )?(?:copyright|licen[sc]e)
odbl-1 ; 0.9 ; open database license ; (?:odc )?open database license(?: (?:v|version )?1 0)?
odc-by-1 ; 0.9 ; open data commons ; open data commons attribution license(?: (?:v|version )?1 0)?
pddl-1 ; 0.9 ; public domain dedication ; (?:odc )?public domain dedication and licen[sc]e
cdla-permissive ; 0.9 ; community data license ; community data license agreement permissive(?: (?:v|version )?\d(?: 0)?)?
cdla-sharing ; 0.9 ; community data license ; community data license agreement sharing(?: (?:v|version )?1 0)?
ogl-3 ; 0.9 ; open government ; open government licen[sc]e(?: (?:v|version )?3(?: 0)?)?
etalab-2 ; 0.9 ; licence ouverte ; licence ouverte(?: (?:v|version )?2 0)?
dl-de-by-2 ; 0.9 ; datenlizenz ; datenlizenz deutschland namensnennung(?: (?:v|version )?2 0)?
dl-de-zero-2 ; 0.9 ; datenlizenz ; datenlizenz deutschland zero(?: (?:v|version )?2 0)?
agpl ; 0.7 ; affero ; (?:gnu )?affero (?:general public licen[sc]e|gpl)
lgpl ; 0.7 ; general public ; (?:gnu )?(?:lesser|library) general public licen[sc]e
gpl ; 0.7 ; general public license ; gnu general public license
fdl ; 0.7 ; free documentation ; (?:gnu )?free documentation licen[sc]e
mpl ; 0.7 ; mozilla public ; mozilla public licen[sc]e
epl ; 0.7 ; eclipse public ; eclipse public licen[sc]e
eupl ; 0.7 ; european union public ; european union public licen[sc]e
apache ; 0.7 ; apache ; apache (?:software )?licen[sc]ed?
bsd ; 0.7 ; bsd ; bsd (?:style )?licen[sc]ed?
isc ; 0.7 ; isc ; isc licen[sc]ed?
zlib ; 0.7 ; zlib ; zlib (?:libpng )?licen[sc]ed?
unlicense ; 0.7 ; unlicense ; (?:the )?unlicense
wtfpl ; 0.7 ; wtfpl ; wtfpl
beerware ; 0.7 ; beer ; beer ?ware(?: licen[sc]e)?
python-2 ; 0.7 ; python software foundation ; python software foundation licen[sc]e
python-2 ; 0.7 ; psf ; psf licen[sc]e
php-3 ; 0.7 ; php ; php licen[sc]e
ruby ; 0.7 ; ruby ; ruby licen[sc]e
artistic ; 0.7 ; artistic ; artistic licen[sc]e
gpl-3 ; 0.8 ; gpl ; (?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
gpl-2 ; 0.8 ; gpl ; (?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only| or later)?
lgpl-3 ; 0.8 ; lgpl ; lgpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
lgpl-2.1 ; 0.8 ; lgpl ; lgpl ?(?:v|version )?2 1(?: only| or later)?
agpl-3 ; 0.8 ; agpl ; agpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
mpl-2 ; 0.8 ; mpl ; mpl ?(?:v|version )?2(?: 0)?
epl-2 ; 0.8 ; epl ; epl ?(?:v|version )?2(?: 0)?
cddl ; 0.7 ; cddl ; cddl(?: 1 [01])?
apache-2 ; 0.9 ; spdx ; spdx license identifier apache 2 0
mit ; 0.9 ; spdx ; spdx license identifier mit
bsd-3-clause ; 0.9 ; spdx ; spdx license identifier bsd 3 clause
bsd-2-clause ; 0.9 ; spdx ; spdx license identifier bsd 2 clause
gpl-2 ; 0.9 ; spdx ; spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 ; 0.9 ; spdx ; spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.1 ; 0.9 ; spdx ; spdx license identifier lgpl 2 1(?: only| or later)?
agpl-3 ; 0.9 ; spdx ; spdx license identifier agpl 3 0(?: only| or later)?
mpl-2 ; 0.9 ; spdx ; spdx license identifier mpl 2 0
isc ; 0.9 ; spdx ; spdx license identifier isc
unlicense ; 0.9 ; spdx ; spdx license identifier unlicense
cc0-1 ; 0.9 ; spdx ; spdx license identifier cc0 1 0
public-domain ; 0.7 ; public domain ; (?:released|dedicated|placed) (?:in|to|into) the public domain
all-rights-reserved ; 0.6 ; all rights reserved ; all rights reserved
all-rights-reserved ; 0.6 ; tous droits ; tous droits réservés
all-rights-reserved ; 0.6 ; alle rechte ; alle rechte vorbehalten
all-rights-reserved ; 0.6 ; todos los derechos ; todos los derechos reservados
"""


def rules(table: str = RULES) -> list[tuple[str, float, str, str]]:
    """(label, strength, keyword, expression) by falling priority, the base phrases first."""
    parsed = [(label, 1.0, phrase, phrase) for phrase, label in BASE_PHRASES.items()]
    for line in table.strip().splitlines():
        label, strength, keyword, expression = line.split(" ; ")
        parsed.append((label, float(strength), keyword, expression))
    return parsed


# A-Z to lower case, every other ASCII character outside a-z and 0-9 to a blank; bytes of
# non-ASCII characters stay, as those characters belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: maximal runs of lower-cased letters, digits and non-ASCII."""
    return text.translate(_FOLD).split()


class Scanner:
    """Detections of the ordered rules in one text at a time."""

    def __init__(self, table: str = RULES):
        self.rules = [(label, strength, keyword.encode(), re.compile(rb"(?<![^ ])(?:" + rx.encode() + rb")(?![^ ])"))
                      for label, strength, keyword, rx in rules(table)]
        self.n_base = len(BASE_PHRASES)
        self.by_keyword: dict[bytes, list[int]] = {}
        for k, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule[2], []).append(k)

    def detections(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(rule, first word, words) of every match, suppression not yet applied."""
        line = b" ".join(words)
        hit = sorted(k for keyword, ks in self.by_keyword.items() if keyword in line for k in ks)
        found = []
        for k in hit:
            at, n = 0, 0    # a byte offset and the number of words before it
            for m in self.rules[k][3].finditer(line):
                n += line.count(b" ", at, m.start())
                at = m.start()
                found.append((k, n, m.group().count(b" ") + 1))
        return found

    def keep(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Drop what lies inside a kept detection of higher priority; base ones stay.

        ``starts`` and ``ends`` hold the kept intervals that no other kept one contains, so
        both rise and one bisection answers a containment test."""
        kept, starts, ends = [], [], []
        for k, first, n in sorted(found, key=lambda d: (d[0], d[1])):
            last = first + n - 1
            at = bisect_right(starts, first) - 1
            inside = at >= 0 and ends[at] >= last
            if inside and k >= self.n_base:
                continue
            kept.append((k, first, n))
            if not inside:
                lo, hi = bisect_left(starts, first), bisect_right(ends, last)
                if lo < hi:     # kept intervals inside the new one no longer matter
                    del starts[lo:hi], ends[lo:hi]
                insort(starts, first)
                insort(ends, last)
        return kept

    def scan(self, text: bytes) -> dict:
        words = word_list(text)
        kept = self.keep(self.detections(words))
        base = [d for d in kept if d[0] < self.n_base]
        return {"n_words": len(words), "n_base": len(base),
                "first_word": min((d[1] for d in base), default=None),
                "last_word": max((d[1] for d in base), default=None),
                "base_labels": ",".join(sorted({self.rules[d[0]][0] for d in base})),
                "labels": ",".join(sorted({self.rules[d[0]][0] for d in kept})),
                "score": max((self.rules[d[0]][1] for d in kept), default=0.0),
                "spans": [f"{d[1]}+{d[2]}:{self.rules[d[0]][0]}" for d in sorted(kept, key=lambda d: (d[1], d[0]))]}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<string>")


def scan_licenses(docs: DataFrame, table: str = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read).

    ``spans`` lists the kept detections as ``first word+words:label``.  A NULL or empty
    text has no words and no detection; a NULL doc_id stays NULL; repeated rows give
    repeated results; an empty table gives an empty one.  Row-local: no shuffle."""

    def start():
        scanner = Scanner(table)

        def work(cols):
            rows = [scanner.scan(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {k: [r[k] for r in rows] for k in
                    ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return map_rows(slim, start, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
