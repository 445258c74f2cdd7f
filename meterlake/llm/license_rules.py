r"""Signature rules of the license scan, written by hand; each line is label | keyword | name patterns.

Patterns are regular expressions over lower-case text whose runs of white space, quotes and comment marks are one
space; several are parted by ' ;; '. A slash is such a mark, so a slash in a pattern or keyword stands for the space
that it has become. A name pattern has priority 3 unless it begins with a digit and a colon. From
each line's identifiers (after the label, in brackets) come two further rules: the SPDX tag (priority 1) and the
identifier next to the word license (priority 3).

Every match of a rule contains one of its keywords: the keyword of its line where the pattern cannot match without
it, else literal strings that are read from the pattern. STEMS is made of the longest of these, so no filter drops a match.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


# Names and wordings of public licenses.
TABLE = r"""
mit [mit] | mit | \bmit license\b ;; \bmit[- ]style licen[cs]e\b ;; \blicensed under (?:the )?mit\b ;; \breleased under (?:the )?(?:terms of the )?mit\b ;; \bexpat license\b
mit | permission is hereby | 2:\bpermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\b
mit | without restriction | 4:\bto deal in the software without restriction\b
mit-0 [mit-0] | mit | \bmit no attribution\b ;; \bmit-0\b
x11 [x11] | x11 | \bx11 license\b ;; \bx11 licence\b
apache-1.1 [apache-1.1] | apache | \bapache (?:software )?license,? (?:version |v)?1\.1\b
apache-2.0 [apache-2.0] | apache | \bapache (?:software )?license,? (?:version |v)?2(?:\.0)?\b ;; \bapache[- ]2(?:\.0)?\b ;; \basl ?2\.0\b ;; 2:\blicensed under the apache license, version 2\.0 \(the license ?\)
apache-2.0 | apache.org | 2:\bapache\.org/licenses/license-2\.0\b
apache-2.0 | distributed under the license | 4:\bunless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis\b
apache | apache | 4:\bapache (?:software )?licen[cs]e\b ;; 4:\bapache[- ]licensed\b
gpl-1.0 [gpl-1.0,gpl-1.0-only,gpl-1.0-or-later] | general public license | \bgnu general public license,? (?:version |v)1\b
gpl-2.0 [gpl-2.0,gpl-2.0-only] | general public license | \bgnu general public license,? (?:version |v)2(?:\.0)?\b ;; \bgeneral public license as published by the free software foundation,? version 2\b
gpl-2.0-or-later [gpl-2.0-or-later,gpl-2.0+] | general public license | 2:\bgnu general public license as published by the free software foundation[;,] either version 2 of the license,? or \(?at your option\)? any later version\b ;; 2:\bgnu general public license,? (?:version |v)2 or (?:any )?later\b
gpl-3.0 [gpl-3.0,gpl-3.0-only] | general public license | \bgnu general public license,? (?:version |v)3(?:\.0)?\b
gpl-3.0-or-later [gpl-3.0-or-later,gpl-3.0+] | general public license | 2:\bgnu general public license as published by the free software foundation[;,] either version 3 of the license,? or \(?at your option\)? any later version\b ;; 2:\bgnu general public license,? (?:version |v)3 or (?:any )?later\b
gpl-2.0 | gpl | \b(?:gnu )?gpl[- ]?(?:version |v)?2(?:\.0)?\b
gpl-3.0 | gpl | \b(?:gnu )?gpl[- ]?(?:version |v)?3(?:\.0)?\b
gpl | gpl | 4:\bgnu gpl\b ;; 4:\bgpl(?:ed)? licen[cs]ed?\b ;; 4:\bunder (?:the )?(?:terms of the )?gpl\b
gpl | general public license | 4:\bgnu general public license\b ;; 4:\bgnu public license\b
gpl | gnu.org | 2:\bgnu\.org/licenses/(?:old-licenses/)?gpl\b ;; 4:\bgnu\.org/copyleft/gpl\b
lgpl-2.0 [lgpl-2.0,lgpl-2.0-only,lgpl-2.0-or-later] | library general public license | \bgnu library general public license\b
lgpl-2.1 [lgpl-2.1,lgpl-2.1-only,lgpl-2.1-or-later] | lesser general public license | \bgnu lesser general public license,? (?:version |v)2\.1\b
lgpl-3.0 [lgpl-3.0,lgpl-3.0-only,lgpl-3.0-or-later] | lesser general public license | \bgnu lesser general public license,? (?:version |v)3(?:\.0)?\b
lgpl | lgpl | 4:\blgpl(?:[- ]?v?[23](?:\.[01])?)?\b
lgpl | lesser general public license | 4:\b(?:gnu )?lesser general public license\b
lgpl | gnu.org | 2:\bgnu\.org/licenses/(?:old-licenses/)?lgpl\b
agpl-3.0 [agpl-3.0,agpl-3.0-only,agpl-3.0-or-later] | affero | \bgnu affero general public license,? (?:version |v)3(?:\.0)?\b
agpl | affero | 4:\b(?:gnu )?affero general public license\b
agpl | agpl | 4:\bagpl(?:[- ]?v?3(?:\.0)?)?\b
agpl | gnu.org | 2:\bgnu\.org/licenses/agpl\b
gfdl-1.3 [gfdl-1.3,gfdl-1.3-only,gfdl-1.3-or-later] | free documentation license | \bgnu free documentation license,? version 1\.3\b
gfdl-1.2 [gfdl-1.2,gfdl-1.2-only,gfdl-1.2-or-later] | free documentation license | \bgnu free documentation license,? version 1\.2\b
gfdl | free documentation license | 4:\bgnu free documentation license\b
bsd-2-clause [bsd-2-clause] | bsd | \b(?:2|two)[- ]clause bsd\b ;; \bsimplified bsd license\b ;; \bfreebsd license\b ;; \bbsd[- ]2[- ]clause\b
bsd-3-clause [bsd-3-clause] | bsd | \b(?:3|three)[- ]clause bsd\b ;; \b(?:new|modified|revised) bsd license\b ;; \bbsd[- ]3[- ]clause\b
bsd-4-clause [bsd-4-clause] | bsd | \b(?:4|four)[- ]clause bsd\b ;; \boriginal bsd license\b ;; \bbsd[- ]4[- ]clause\b
bsd-3-clause | endorse or promote | 2:\bneither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products\b
bsd-4-clause | advertising materials | 2:\ball advertising materials mentioning features or use of this software must display\b
bsd | redistribution and use | 4:\bredistribution and use in source and binary forms, with or without modification, are permitted\b
bsd | bsd | 4:\bbsd(?:[- ]style)? licen[cs]ed?\b
0bsd [0bsd] | bsd | \bzero[- ]clause bsd\b ;; \b0bsd\b
isc [isc] | isc | \bisc licen[cs]e\b ;; \binternet systems consortium license\b
isc | permission to use, copy | 2:\bpermission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\b
mpl-1.0 [mpl-1.0] | mozilla | \bmozilla public license,? (?:version |v)?1\.0\b
mpl-1.1 [mpl-1.1] | mozilla | \bmozilla public license,? (?:version |v)?1\.1\b
mpl-2.0 [mpl-2.0] | mozilla | \bmozilla public license,? (?:version |v\. ?|v)?2(?:\.0)?\b ;; \bmpl[- ]2(?:\.0)?\b
mpl-2.0 | mozilla.org | 2:\bmozilla\.org/mpl/2\.0\b
mpl | mozilla | 4:\bmozilla public licen[cs]e\b
epl-1.0 [epl-1.0] | eclipse | \beclipse public license,? (?:version |v)?1\.0\b
epl-2.0 [epl-2.0] | eclipse | \beclipse public license,? (?:version |v)?2\.0\b
epl | eclipse | 4:\beclipse public licen[cs]e\b
edl-1.0 | eclipse | \beclipse distribution license,? (?:version |v)?1\.0\b
cddl-1.0 [cddl-1.0] | common development and distribution | \bcommon development and distribution license,? (?:\(cddl\) )?(?:version |v)?1\.0\b
cddl-1.1 [cddl-1.1] | common development and distribution | \bcommon development and distribution license,? (?:\(cddl\) )?(?:version |v)?1\.1\b
cddl | cddl | 4:\bcddl\b
cpl-1.0 [cpl-1.0] | common public license | \bcommon public license,? (?:version |v)?1\.0\b ;; 4:\bcommon public license\b
ipl-1.0 [ipl-1.0] | ibm public license | \bibm public license\b
osl-3.0 [osl-3.0] | open software license | \bopen software license,? (?:version |v)?3\.0\b ;; 4:\bopen software license\b
afl-3.0 [afl-3.0] | academic free license | \bacademic free license,? (?:version |v)?3\.0\b ;; 4:\bacademic free license\b
artistic-1.0 [artistic-1.0,artistic-1.0-perl] | artistic | \bartistic license,? (?:version |v)?1\.0\b
artistic-2.0 [artistic-2.0] | artistic | \bartistic license,? (?:version |v)?2\.0\b
artistic | artistic | 4:\bartistic licen[cs]e\b ;; 4:\bsame terms as perl itself\b
ms-pl [ms-pl] | microsoft public license | \bmicrosoft public license\b
ms-rl [ms-rl] | microsoft reciprocal license | \bmicrosoft reciprocal license\b
bsl-1.0 [bsl-1.0] | boost | \bboost software license(?:,? (?:version |v)?1\.0)?\b
bsl-1.0 | boost.org | 2:\bboost\.org/license_1_0\b
busl-1.1 [busl-1.1] | business source | \bbusiness source license(?:,? (?:version |v)?1\.1)?\b
sspl-1.0 [sspl-1.0] | server side public | \bserver side public license\b
elastic-2.0 [elastic-2.0] | elastic license | \belastic license(?:,? (?:version |v)?2(?:\.0)?)?\b
commons-clause | commons clause | \bcommons clause\b
zlib [zlib] | zlib | \bzlib(?:/libpng)? licen[cs]e\b
zlib | misrepresented | 2:\bthe origin of this software must not be misrepresented\b
libpng [libpng,libpng-2.0] | libpng | \blibpng licen[cs]e\b
unlicense [unlicense] | unlicense | \bthe unlicense\b ;; \bunlicense\.org\b
unlicense | unencumbered | 2:\bfree and unencumbered software released into the public domain\b
public-domain | public domain | 4:\b(?:released|placed|dedicated) (?:in)?to the public domain\b ;; 4:\bis in the public domain\b
wtfpl [wtfpl] | wtfpl | \bwtfpl\b
wtfpl | do what the | \bdo what the (?:[a-z][a-z ]{0,7} )?you want to public license\b
postgresql [postgresql] | postgresql | \bpostgresql licen[cs]e\b
python-2.0 [python-2.0,psf-2.0] | python software foundation | \bpython software foundation license(?: version 2)?\b
php-3.01 [php-3.01,php-3.0] | php license | \bphp license,? (?:version |v)?3\.0[01]?\b ;; 4:\bphp license\b
ruby [ruby] | ruby | \bruby licen[cs]e\b ;; 4:\bsame terms as ruby\b
openssl [openssl] | openssl | \bopenssl licen[cs]e\b
ssleay [ssleay] | ssleay | \bssleay licen[cs]e\b
curl [curl] | curl | \bcurl licen[cs]e\b
w3c [w3c] | w3c | \bw3c software (?:notice and )?licen[cs]e\b
unicode [unicode-dfs-2016,unicode-3.0] | unicode | \bunicode licen[cs]e(?: agreement)?\b
icu [icu] | icu license | \bicu licen[cs]e\b
ncsa [ncsa] | ncsa | \buniversity of illinois/ncsa open source license\b ;; \bncsa (?:open source )?license\b
ofl-1.1 [ofl-1.1,ofl-1.0] | open font license | \b(?:sil )?open font license(?:,? version 1\.1)?\b
eupl-1.1 [eupl-1.1] | european union public | \beuropean union public licen[cs]e,? (?:\(eupl\) )?(?:version |v\.? ?)?1\.1\b
eupl-1.2 [eupl-1.2] | european union public | \beuropean union public licen[cs]e,? (?:\(eupl\) )?(?:version |v\.? ?)?1\.2\b
eupl | eupl | 4:\beupl\b
cecill-2.1 [cecill-2.1,cecill-2.0] | cecill | \bcecill(?: free software)? licen[cs]e(?: agreement)?\b
upl-1.0 [upl-1.0] | universal permissive | \buniversal permissive license\b
vim [vim] | vim license | \bvim licen[cs]e\b
sleepycat [sleepycat] | sleepycat | \bsleepycat licen[cs]e\b
tcl [tcl] | tcl | \btcl/tk licen[cs]e\b ;; \btcl licen[cs]e\b
beerware [beerware] | beer | \bbeer-?ware licen[cs]e\b ;; \bthe beer-ware license\b
json [json] | good, not evil | 2:\bthe software shall be used for good, not evil\b
odbl-1.0 [odbl-1.0] | open database license | \bopen database license\b ;; 4:\bodbl\b
odc-by-1.0 [odc-by-1.0] | open data commons | \bopen data commons attribution license\b
pddl-1.0 [pddl-1.0] | public domain dedication | \bopen data commons public domain dedication\b
cc0-1.0 [cc0-1.0] | cc0 | \bcc0(?:[- ]1\.0)?(?: universal)?\b
cc0-1.0 | publicdomain/zero | 2:\bcreativecommons\.org/publicdomain/zero\b
cc-by-sa [cc-by-sa-3.0,cc-by-sa-4.0] | cc | \bcc[- ]by[- ]sa(?:[- ][1-4]\.0)?\b
cc-by-nd [cc-by-nd-4.0] | cc | \bcc[- ]by[- ]nd(?:[- ][1-4]\.0)?\b
cc-by-nc [cc-by-nc-4.0] | cc | \bcc[- ]by[- ]nc(?:[- ][1-4]\.0)?\b
cc-by-nc-sa [cc-by-nc-sa-4.0] | cc | \bcc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.0)?\b
cc-by-nc-nd [cc-by-nc-nd-4.0] | cc | \bcc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.0)?\b
cc-by [cc-by-3.0,cc-by-4.0] | cc | \bcc[- ]by(?:[- ][1-4]\.0)?\b
cc-by | creative commons | \bcreative commons attribution(?: [1-4]\.0)?(?: international| unported)?(?: public)? licen[cs]e\b
cc-by-sa | creative commons | \bcreative commons attribution[- ]share[- ]?alike\b
cc-by-nc | creative commons | \bcreative commons attribution[- ]non-?commercial\b
cc-by-nd | creative commons | \bcreative commons attribution[- ]no[- ]?deriv(?:ative)?s\b
cc-by | creativecommons.org | 2:\bcreativecommons\.org/licenses/by/[1-4]\.0\b
cc-by-sa | creativecommons.org | 2:\bcreativecommons\.org/licenses/by-sa/[1-4]\.0\b
cc-by-nc | creativecommons.org | 2:\bcreativecommons\.org/licenses/by-nc/[1-4]\.0\b
cc-by-nc-sa | creativecommons.org | 2:\bcreativecommons\.org/licenses/by-nc-sa/[1-4]\.0\b
cc-by-nc-nd | creativecommons.org | 2:\bcreativecommons\.org/licenses/by-nc-nd/[1-4]\.0\b
cc-by-nd | creativecommons.org | 2:\bcreativecommons\.org/licenses/by-nd/[1-4]\.0\b
openrail [openrail] | openrail | \b(?:creativeml )?open ?rail(?:\+\+)?(?:-m)?\b
proprietary | all rights reserved | 4:\ball rights reserved\b
proprietary | proprietary | \bproprietary and confidential\b
mit | permission notice | 2:\bthe above copyright notice and this permission notice shall be included in all copies or substantial portions of the software\b
mit | without warranty of any kind | 4:\bthe software is provided as is ?, without warranty of any kind, express or implied\b
mit-modern | modern variant | \bmit license modern variant\b
x11 | x consortium | 4:\bexcept as contained in this notice, the name of the x consortium shall not be used\b
hpnd [hpnd] | historical permission notice | \bhistorical permission notice and disclaimer\b
hpnd | supporting documentation | 4:\bthat the above copyright notice appears? in all copies and that both (?:that|the) copyright notice and this permission notice appear in supporting documentation\b
ntp [ntp] | ntp license | \bntp license\b
fair [fair] | fair license | \bfair license\b
apache-1.0 [apache-1.0] | apache | \bapache (?:software )?license,? (?:version |v)?1\.0\b
apache-1.1 | apache.org | 2:\bapache\.org/licenses/license-1\.1\b
apache-2.0 | except in compliance | 2:\byou may not use this file except in compliance with the license\b
apache-2.0 | obtain a copy of the license | 4:\byou may obtain a copy of the license at\b
apache-2.0-llvm | llvm exception | \bapache license v2\.0 with llvm exceptions?\b ;; \bllvm exceptions? to the apache 2\.0 license\b
gpl | you can redistribute it | 4:\byou can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu general public license\b
gpl | received a copy | 4:\byou should have received a copy of the gnu general public license\b
lgpl | you can redistribute it | 2:\byou can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu (?:lesser|library) general public license\b
lgpl | received a copy | 2:\byou should have received a copy of the gnu (?:lesser|library) general public license\b
agpl | you can redistribute it | 2:\byou can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu affero general public license\b
agpl | received a copy | 2:\byou should have received a copy of the gnu affero general public license\b
classpath-exception | classpath | \bclasspath(?:[- ]linking)? exception\b
gcc-exception | gcc runtime | \bgcc runtime library exception\b
bison-exception | bison | \bbison exception\b
autoconf-exception | autoconf | \bautoconf (?:macro |script )?exception\b
font-exception | font exception | \bgpl font exception\b
linking-exception | linking exception | 4:\blinking exception\b
fsfap [fsfap] | medium without royalty | 2:\bcopying and distribution of this file, with or without modification, are permitted in any medium without royalty\b
gfdl | permission is granted to copy | 2:\bpermission is granted to copy, distribute and ?(?:/ ?)?or modify this document under the terms of the gnu free documentation license\b
bsd-2-clause | source code must retain | 4:\bredistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer\b
bsd-2-clause | in binary form must reproduce | 4:\bredistributions in binary form must reproduce the above copyright notice\b
bsd-3-clause-clear [bsd-3-clause-clear] | clear bsd | \bclear bsd license\b
bsd-2-clause-patent [bsd-2-clause-patent] | patent | \bbsd[- ]2[- ]clause plus patent\b
bsd-1-clause [bsd-1-clause] | bsd | \b(?:1|one)[- ]clause bsd\b ;; \bbsd[- ]1[- ]clause\b
isc | disclaims all warranties | 4:\bthe software is provided as is and the author disclaims all warranties\b
mpl-2.0 | source code form | 2:\bthis source code form is subject to the terms of the mozilla public license, v\. 2\.0\b
mpl-2.0 | mpl was not distributed | 2:\bif a copy of the mpl was not distributed with this file\b
mpl-1.1 | contents of this file | 2:\bthe contents of this file are subject to the mozilla public license version 1\.1\b
npl-1.1 [npl-1.0,npl-1.1] | netscape | \bnetscape public license\b
epl | accompanying materials | 4:\bthis program and the accompanying materials are made available under the terms of the eclipse public license\b
cddl | contents of this file | 2:\bthe contents of this file are subject to the terms of the common development and distribution license\b
cpal-1.0 [cpal-1.0] | common public attribution | \bcommon public attribution license\b
osl-2.1 [osl-2.1] | open software license | \bopen software license,? (?:version |v)?2\.1\b
nposl-3.0 [nposl-3.0] | non-profit | \bnon-profit open software license\b
afl-2.1 [afl-2.1] | academic free license | \bacademic free license,? (?:version |v)?2\.1\b
apsl-2.0 [apsl-1.2,apsl-2.0] | apple public source | \bapple public source license\b
apl-1.0 [apl-1.0] | adaptive public | \badaptive public license\b
aal [aal] | attribution assurance | \battribution assurance license\b
blueoak-1.0.0 [blueoak-1.0.0] | blue oak | \bblue oak model license\b
bittorrent-1.1 [bittorrent-1.1] | bittorrent | \bbittorrent open source license\b
catosl-1.1 [catosl-1.1] | trusted open source | \bcomputer associates trusted open source license\b
cua-opl-1.0 [cua-opl-1.0] | cua office | \bcua office public license\b
ecl-2.0 [ecl-1.0,ecl-2.0] | educational community | \beducational community license\b
ecos-2.0 [ecos-2.0] | ecos license | \becos license\b
efl-2.0 [efl-1.0,efl-2.0] | eiffel forum | \beiffel forum license\b
entessa [entessa] | entessa | \bentessa public license\b
eudatagrid [eudatagrid] | datagrid | \beu datagrid software license\b
frameworx-1.0 [frameworx-1.0] | frameworx | \bframeworx open license\b
intel [intel] | intel open source | \bintel open source license\b
jam [jam] | jam license | \bjam license\b
lpl-1.02 [lpl-1.0,lpl-1.02] | lucent public | \blucent public license\b
lppl-1.3c [lppl-1.3c] | latex project | \blatex project public license\b
liliq [liliq-p-1.1,liliq-r-1.1] | licence libre | \blicence libre du qu[eé]bec\b
miros [miros] | miros licen | \bmiros licen[cs]e\b
motosoto [motosoto] | motosoto | \bmotosoto (?:open source )?license\b
mulanpsl-2.0 [mulanpsl-1.0,mulanpsl-2.0] | mulan psl | \bmulan psl ?(?:v[12])?\b ;; \bmulan permissive software license\b
multics [multics] | multics license | \bmultics license\b
nasa-1.3 [nasa-1.3] | nasa open source | \bnasa open source agreement\b
naumen [naumen] | naumen | \bnaumen public license\b
ngpl [ngpl] | nethack | \bnethack general public license\b
nokia [nokia] | nokia open source | \bnokia open source license\b
oclc-2.0 [oclc-2.0] | oclc | \boclc research public license\b
ogtsl [ogtsl] | open group test suite | \bopen group test suite license\b
oldap-2.8 [oldap-2.8] | openldap | \bopenldap public license\b
qpl-1.0 [qpl-1.0] | q public license | \bq public license\b
rpl-1.5 [rpl-1.1,rpl-1.5] | reciprocal public license | \breciprocal public license\b
rpsl-1.0 [rpsl-1.0] | realnetworks | \brealnetworks public source license\b
rscpl [rscpl] | ricoh | \bricoh source code public license\b
simpl-2.0 [simpl-2.0] | simple public license | \bsimple public license\b
spl-1.0 [spl-1.0] | sun public license | \bsun public license\b
sissl [sissl] | sun industry standards | \bsun industry standards source license\b
vsl-1.0 [vsl-1.0] | vovida | \bvovida software license\b
watcom-1.0 [watcom-1.0] | open watcom | \bsybase open watcom public license\b
wxwindows [wxwindows] | wxwindows | \bwxwindows library licen[cs]e\b
xnet [xnet] | x.net | \bx\.net license\b
zpl-2.1 [zpl-2.0,zpl-2.1] | zope public license | \bzope public license\b
zlib | plainly marked | 4:\baltered source versions must be plainly marked as such\b
zlib | source distribution | 4:\bthis notice may not be removed or altered from any source distribution\b
bzip2 [bzip2-1.0.6] | bzip2 license | \bbzip2 license\b
info-zip [info-zip] | info-zip | \binfo-zip license\b
imagemagick [imagemagick] | imagemagick license | \bimagemagick license\b
ftl [ftl] | freetype | \bfreetype (?:project )?license\b
ijg [ijg] | independent jpeg group | 4:\bbased in part on the work of the independent jpeg group\b
openssl | openssl toolkit | 2:\bsoftware developed by the openssl project for use in the openssl toolkit\b
unlicense | anyone is free | 2:\banyone is free to copy, modify, publish, use, compile, sell, or distribute this software\b
wtfpl | you just do what | 2:\byou just do what the (?:[a-z]{1,8} )?you want to\b
bsl-1.0 | august 17th | 2:\bboost software license - version 1\.0 - august 17th, 2003\b
python-2.0 | psf license agreement | \bpsf license agreement for python\b ;; \bcnri open source license agreement\b
ofl-1.1 | font software is licensed | 2:\bthis font software is licensed under the sil open font license\b
cc0-1.0 | related or neighboring rights | 2:\bwaived all copyright and related or neighboring rights\b
cc0-1.0 | creative commons | \bcreative commons (?:cc0|zero)\b
cc-by-nc-sa | creative commons | 2:\bcreative commons attribution[- ]non-?commercial[- ]share[- ]?alike\b
cc-by-nc-nd | creative commons | 2:\bcreative commons attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative)?s\b
odc-by-1.0 | odc-by | 4:\bodc-by\b
ogl-uk-3.0 [ogl-uk-1.0,ogl-uk-2.0,ogl-uk-3.0] | open government licence | \bopen government licence\b
etalab-2.0 [etalab-2.0] | licence ouverte | \blicence ouverte\b
dl-de-by-2.0 [dl-de-by-2.0] | datenlizenz deutschland | \bdatenlizenz deutschland\b
cdla-permissive-2.0 [cdla-permissive-1.0,cdla-permissive-2.0] | community data license | \bcommunity data license agreement,? permissive\b
cdla-sharing-1.0 [cdla-sharing-1.0] | community data license | \bcommunity data license agreement,? sharing\b
c-uda-1.0 [c-uda-1.0] | computational use of data | \bcomputational use of data agreement\b
lal-1.3 [lal-1.2,lal-1.3] | free art license | \bfree art license\b
opubl-1.0 [opubl-1.0] | open publication license | \bopen publication license\b
dsl | design science | \bdesign science license\b
cern-ohl [cern-ohl-p-2.0,cern-ohl-s-2.0,cern-ohl-w-2.0] | cern open hardware | \bcern open hardware licen[cs]e\b
shl [shl-0.51,shl-2.1] | solderpad | \bsolderpad hardware licen[cs]e\b
tapr-ohl-1.0 [tapr-ohl-1.0] | tapr open hardware | \btapr open hardware license\b
hippocratic-2.1 [hippocratic-2.1] | hippocratic license | \bhippocratic license\b
parity-7.0.0 [parity-6.0.0,parity-7.0.0] | parity public | \bparity public license\b
prosperity | prosperity public | \bprosperity public license\b
polyform-noncommercial [polyform-noncommercial-1.0.0] | polyform noncommercial | \bpolyform noncommercial license\b
polyform-small-business [polyform-small-business-1.0.0] | polyform small business | \bpolyform small business license\b
polyform-strict | polyform strict | \bpolyform strict license\b
confluent | confluent community | \bconfluent community license\b
timescale | timescale license | \btimescale license\b
rsal | redis source available | \bredis source available license\b
fsl [fsl-1.1-alv2,fsl-1.1-mit] | functional source | \bfunctional source license\b
sspl-1.0 | sspl | 4:\bsspl(?: ?v?1(?:\.0)?)?\b
busl-1.1 | additional use grant | 4:\badditional use grant\b
llama | llama | \bllama [0-9](?:\.[0-9])? community license\b
gemma | gemma terms | \bgemma terms of use\b
openrail | rail license | 4:\b(?:bigscience|bigcode|responsible ai) (?:open ?)?rail license\b
amazon-software | amazon software license | \bamazon software license\b
oracle-bcl | oracle binary code | \boracle binary code license\b
sun-bcl | sun binary code | \bsun microsystems,? inc\.? binary code license\b
otn | oracle technology network | \boracle technology network (?:developer )?license\b
eula | end user license | 4:\bend[- ]user licen[cs]e agreement\b
proprietary | confidential and proprietary | \bconfidential and proprietary information of\b
proprietary | property of | 4:\blicensed materials - property of\b
proprietary | distribution | 4:\bnot for (?:re)?distribution\b
proprietary | copying of this file | 4:\bunauthori[sz]ed copying of this file\b
proprietary | trade secrets | 4:\bcontains trade secrets (?:of|and)\b
anti-996 | anti 996 | \banti ?996 license\b
"""


#: Strings that one stretch of a pattern may stand for, at most.
FORMS = 8
#: What the keywords of most rules have in common, so that they need no stem of their own.
ROOTS = ("licen", "gpl", "spdx")


def forms(nodes: list) -> set[str] | None:
    """All strings that a stretch of a parsed pattern matches; None if they are many or not literal."""
    found = {""}
    for op, arg in nodes:
        match str(op):
            case "AT" | "ASSERT_NOT":
                more = {""}
            case "LITERAL":
                more = {chr(arg)}
            case "IN":
                more = {chr(x) for kind, x in arg if str(kind) == "LITERAL"} if all(str(kind) == "LITERAL" for kind, _ in arg) else None
            case "SUBPATTERN":
                more = forms(arg[3])
            case "BRANCH":
                some = [forms(x) for x in arg[1]]
                more = None if None in some else set().union(*some)
            case "MAX_REPEAT" if arg[1] == 1:
                more = forms(arg[2])
                more = more if arg[0] or more is None else more | {""}
            case _:
                more = None
        found = found and more and {a + b for a in found for b in more}
        if not found or len(found) > FORMS:
            return None
    return found


@lru_cache(maxsize=None)
def needed(pattern: str) -> list[set[str]]:
    """Sets of strings; every match of the pattern contains one string of each set."""
    alone = [forms([node]) for node in _parser.parse(pattern)]
    found = []
    for a in range(len(alone)):
        stretch = {""}
        for more in alone[a:]:
            longer = {x + y for x in stretch for y in more} if more else set()
            if not 0 < len(longer) <= FORMS:
                break
            stretch = longer
        found.append(stretch)
    return [x for x in found if "" not in x]


def keywords(pattern: str, wanted: str | None = None) -> tuple[str, ...]:
    some = needed(pattern)
    if wanted and any(all(wanted in x for x in one) for one in some):
        return (wanted,)
    best = max(some, key=lambda one: (min(map(len, one)), -len(one)))
    return tuple(sorted(x for x in best if not any(y in x for y in best - {x})))


def rules(table: str = TABLE) -> list[Rule]:
    found = []
    table = table.replace("/", " ")
    for line in table.strip().splitlines():
        head, keyword, names = (x.strip() for x in line.split(" | ", 2))
        label, _, ids = head.partition(" [")
        for pattern in names.split(" ;; "):
            m = re.match(r"([1-4]):", pattern)
            pattern = pattern[2:] if m else pattern
            found.append(Rule(label, int(m[1]) if m else 3, keywords(pattern, keyword), pattern))
        for name in ids.rstrip("]").split(",") if ids else []:
            exact = re.escape(name).replace("\\-", "-")
            for own, priority, pattern in (
                (name, 1, rf"\bspdx-license-identifier: ?\(?{exact}(?![\w.+-])"),
                (label, 3, rf"\blicen[cs]e(?:d under)?:? ?\(?{exact}(?![\w.+-])"),
            ):
                found.append(Rule(own, priority, keywords(pattern, name), pattern))
    return sorted(found, key=lambda r: r.priority)


RULES = rules()


def stems(some: list[Rule]) -> str:
    """A pattern that finds the longest strings needed by any rule in a text whose marks are not yet flattened, shared beginnings once."""
    words = {k for r in some for k in keywords(r.pattern)} | set(ROOTS)
    tree = {}
    for word in sorted(w for w in words if not any(x in w for x in words - {w})):
        node = tree
        for c in word:
            node = node.setdefault(c, {})

    def written(node: dict) -> str:
        one = [(MARKS if c == " " else re.escape(c)) + written(rest) for c, rest in node.items()]
        return one[0] if len(one) == 1 else f"(?:{'|'.join(one)})" if one else ""

    return written(tree)


#: What is flattened to one space.
MARKS = r"""[\s*#/>"']+"""
#: A text without a match of this has no rule to try.
STEMS = stems(RULES)
