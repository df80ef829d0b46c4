r"""Signature rules of licences: a label, a priority and a regular expression over lower-cased text, one a line.

A blank stands for white space and the marks that comments put before their lines. Priorities: 95 identifiers, 90 bodies, 85
notices of headers, 80 addresses, 70 statements, 50 fields, 30 names, 20 names without a version.
"""

RULES = r"""
# MIT and its relatives
mit 95 spdx-license-identifier: \(?mit
mit 90 permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit 90 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 80 opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html|/)?
mit 80 mit-license\.org
mit 70 (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: open source)? licen[cs]e
mit 70 (?:in accordance with|subject to|covered by|governed by) (?:the )?(?:terms of )?(?:the )?(?:mit|expat) licen[cs]e
mit 70 this (?:software|project|library|package|code|work) is mit[- ]licensed
mit 50 licen[cs]e ?[:=] ?['"]?mit
mit 50 \(mit or apache-2\.0\)
mit 30 (?:mit|expat)(?:/x11)? licen[cs]e
mit 30 mit/x11
mit-0 95 spdx-license-identifier: \(?mit-0
mit-0 30 mit no attribution
mit-0 30 mit-0
x11 95 spdx-license-identifier: \(?x11
x11 90 except as contained in this notice, the name of the x consortium shall not be used in advertising
x11 30 x11 licen[cs]e
isc 95 spdx-license-identifier: \(?isc
isc 90 permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
isc 80 opensource\.org/licenses?/isc(?:-license)?(?:\.txt|\.html|/)?
isc 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
isc 50 licen[cs]e ?[:=] ?['"]?isc
isc 30 (?:isc|internet systems consortium) licen[cs]e
0bsd 95 spdx-license-identifier: \(?0bsd
0bsd 90 permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
0bsd 30 (?:zero[- ]clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
ntp 95 spdx-license-identifier: \(?ntp
ntp 90 permission to use, copy, modify, and distribute this software and its documentation for any purpose (?:with or without|and without) fee is hereby granted
hpnd 95 spdx-license-identifier: \(?hpnd
hpnd 30 historical permission notice and disclaimer
curl 95 spdx-license-identifier: \(?curl
curl 30 curl licen[cs]e
ncsa 95 spdx-license-identifier: \(?ncsa
ncsa 90 permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal with the software
ncsa 30 (?:university of illinois/)?ncsa(?: open source)? licen[cs]e
afl-3 95 spdx-license-identifier: \(?afl-3\.0
afl-3 30 academic free licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?
ecl-2 95 spdx-license-identifier: \(?ecl-2\.0
ecl-2 30 educational community licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
beerware 95 spdx-license-identifier: \(?beerware
beerware 90 as long as you retain this notice you can do whatever you want with this stuff\. if we meet some day
beerware 30 beer-?ware licen[cs]e
wtfpl 95 spdx-license-identifier: \(?wtfpl
wtfpl 90 everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
wtfpl 80 wtfpl\.net
wtfpl 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?wtfpl
wtfpl 30 do what the fuck you want to public licen[cs]e
wtfpl 30 the wtfpl
# BSD
bsd-2-clause 95 spdx-license-identifier: \(?bsd-2-clause(?:-patent|-views)?
bsd-2-clause 80 opensource\.org/licenses?/bsd-2-clause
bsd-2-clause 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:simplified|2-clause|two-clause|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause 50 licen[cs]e ?[:=] ?['"]?bsd[- ]2[- ]clause
bsd-2-clause 30 bsd[- ]2[- ]clause(?: licen[cs]e)?
bsd-2-clause 30 (?:simplified|freebsd|2-clause|two-clause) bsd(?: licen[cs]e)?
bsd-3-clause 95 spdx-license-identifier: \(?bsd-3-clause(?:-clear|-lbnl)?
bsd-3-clause 90 neither the name of .{1,80}? nor the names of (?:its|any|the|other) ?contributors may be used to endorse or promote products
bsd-3-clause 80 opensource\.org/licenses?/bsd-3-clause
bsd-3-clause 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:new|modified|revised|3-clause|three-clause) bsd(?: licen[cs]e)?
bsd-3-clause 50 licen[cs]e ?[:=] ?['"]?bsd[- ]3[- ]clause
bsd-3-clause 30 bsd[- ]3[- ]clause(?: licen[cs]e)?
bsd-3-clause 30 (?:new|modified|revised|3-clause|three-clause) bsd(?: licen[cs]e)?
bsd-4-clause 95 spdx-license-identifier: \(?bsd-4-clause(?:-uc)?
bsd-4-clause 90 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause 30 bsd[- ]4[- ]clause(?: licen[cs]e)?
bsd-4-clause 30 (?:original|4-clause|four-clause|old) bsd(?: licen[cs]e)?
bsd 90 redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd 85 redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd 85 use of this source code is governed by a bsd-style licen[cs]e that can be found in the licen[cs]e file
bsd 80 opensource\.org/licenses?/bsd-license(?:\.php|\.html)?
bsd 70 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?:-style)? licen[cs]e
bsd 50 licen[cs]e ?[:=] ?['"]?bsd
bsd 20 bsd(?:-style)? licen[cs]e
# Apache
apache-2 95 spdx-license-identifier: \(?apache-2\.0
apache-2 90 terms and conditions for use, reproduction, and distribution 1\. definitions\. "license" shall mean the terms and conditions for use
apache-2 85 licensed under the apache licen[cs]e,? version 2\.0 \(the "licen[cs]e"\)
apache-2 85 licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements
apache-2 80 apache\.org/licenses/licen[cs]e-2\.0(?:\.txt|\.html)?
apache-2 80 opensource\.org/licenses?/apache-2\.0
apache-2 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,? \(?(?:version |v\.? ?)?2(?:\.0)?\)?
apache-2 70 (?:governed|covered) by (?:the )?apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
apache-2 60 (?:or|and) apache-2\.0
apache-2 50 licen[cs]e ?[:=] ?['"]?apache(?:[- ]licen[cs]e)?[- ,]{0,2}(?:version |v)?2(?:\.0)?
apache-2 30 apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
apache-2 30 asl ?2\.0
apache-1.1 95 spdx-license-identifier: \(?apache-1\.1
apache-1.1 90 this product includes software developed by the apache software foundation
apache-1.1 30 apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?1\.1
apache-1 95 spdx-license-identifier: \(?apache-1\.0
apache-1 30 apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?1\.0
apache 70 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
apache 20 apache(?: software)? licen[cs]e
# GNU
gpl-1 95 spdx-license-identifier: \(?gpl-1\.0(?:-only|-or-later|\+)?
gpl-1 30 (?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v\.? ?)?1(?:\.0)?
gpl-2 95 spdx-license-identifier: \(?gpl-2\.0(?:-only|-or-later|\+)?
gpl-2 90 gnu general public licen[cs]e version 2, june 1991
gpl-2 85 gnu general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 2
gpl-2 85 under the terms of the gnu general public licen[cs]e,? version 2,? (?:or \(at your option\) any later version|only|as published)
gpl-2 85 either version 2 of the licen[cs]e,? or \(?at your option\)? any later version
gpl-2 80 gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.html|\.txt)?
gpl-2 80 opensource\.org/licenses?/gpl-2\.0(?:\.php)?
gpl-2 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?-?(?:version |v\.? ?)?2(?:\.0)?
gpl-2 60 (?:or|and) gpl-2\.0(?:-only|-or-later)?
gpl-2 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?gpl[- ]?v?2(?:\.0)?
gpl-2 30 (?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?)?2(?:\.0)?
gpl-2 30 gplv2\+?
gpl-3 95 spdx-license-identifier: \(?gpl-3\.0(?:-only|-or-later|\+)?
gpl-3 90 gnu general public licen[cs]e version 3, 29 june 2007
gpl-3 85 gnu general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 3
gpl-3 85 under the terms of the gnu general public licen[cs]e,? version 3,? (?:or \(at your option\) any later version|only|as published)
gpl-3 85 either version 3 of the licen[cs]e,? or \(?at your option\)? any later version
gpl-3 80 gnu\.org/licenses/gpl-3\.0(?:\.html|\.txt)?
gpl-3 80 opensource\.org/licenses?/gpl-3\.0(?:\.php|\.html)?
gpl-3 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?-?(?:version |v\.? ?)?3(?:\.0)?
gpl-3 60 (?:or|and) gpl-3\.0(?:-only|-or-later)?
gpl-3 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?gpl[- ]?v?3(?:\.0)?
gpl-3 30 (?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?)?3(?:\.0)?
gpl-3 30 gplv3\+?
gpl 90 everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
gpl 85 without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[cs]e
gpl 85 you should have received a copy of the gnu general public licen[cs]e along with this
gpl 80 gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?
gpl 70 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl)
gpl 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?gpl
gpl 20 gnu (?:general public licen[cs]e|gpl)
lgpl-2 95 spdx-license-identifier: \(?lgpl-2\.0(?:-only|-or-later|\+)?
lgpl-2 90 gnu library general public licen[cs]e version 2, june 1991
lgpl-2 85 gnu library general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 2
lgpl-2 30 (?:gnu )?(?:(?:library|lesser) general public licen[cs]e|lgpl),? ?(?:version |v\.? ?)?2(?:\.0)?
lgpl-2.1 95 spdx-license-identifier: \(?lgpl-2\.1(?:-only|-or-later|\+)?
lgpl-2.1 90 gnu lesser general public licen[cs]e version 2\.1, february 1999
lgpl-2.1 85 gnu lesser general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 2\.1
lgpl-2.1 85 either version 2\.1 of the licen[cs]e,? or \(?at your option\)? any later version
lgpl-2.1 80 gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.html|\.txt)?
lgpl-2.1 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?-?(?:version |v\.? ?)?2\.1
lgpl-2.1 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?lgpl[- ]?v?2\.1
lgpl-2.1 30 (?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?)?2\.1
lgpl-3 95 spdx-license-identifier: \(?lgpl-3\.0(?:-only|-or-later|\+)?
lgpl-3 90 this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e
lgpl-3 85 gnu lesser general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 3
lgpl-3 80 gnu\.org/licenses/lgpl-3\.0(?:\.html|\.txt)?
lgpl-3 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?-?(?:version |v\.? ?)?3(?:\.0)?
lgpl-3 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?lgpl[- ]?v?3(?:\.0)?
lgpl-3 30 (?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?)?3(?:\.0)?
lgpl 85 you should have received a copy of the gnu lesser general public licen[cs]e along with this
lgpl 80 gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)(?:\.html|\.txt)?
lgpl 70 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl)
lgpl 20 gnu (?:lesser general public licen[cs]e|lgpl)
agpl-1 30 affero general public licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?
agpl-3 95 spdx-license-identifier: \(?agpl-3\.0(?:-only|-or-later|\+)?
agpl-3 90 gnu affero general public licen[cs]e version 3, 19 november 2007
agpl-3 85 gnu affero general public licen[cs]e,? as published by the free software foundation[;,] (?:either )?version 3
agpl-3 80 gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?
agpl-3 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl),? ?-?(?:version |v\.? ?)?3(?:\.0)?
agpl-3 50 licen[cs]e ?[:=] ?['"]?(?:gnu )?agpl[- ]?v?3(?:\.0)?
agpl-3 30 (?:gnu )?(?:affero general public licen[cs]e|agpl)(?:,? ?(?:version |v\.? ?)?3(?:\.0)?)?
gfdl-1.1 95 spdx-license-identifier: \(?gfdl-1\.1(?:-only|-or-later)?
gfdl-1.2 95 spdx-license-identifier: \(?gfdl-1\.2(?:-only|-or-later)?
gfdl-1.3 95 spdx-license-identifier: \(?gfdl-1\.3(?:-only|-or-later)?
gfdl-1.2 30 (?:gnu )?free documentation licen[cs]e,? (?:version |v\.? ?)?1\.2
gfdl-1.3 30 (?:gnu )?free documentation licen[cs]e,? (?:version |v\.? ?)?1\.3
gfdl 85 permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 80 gnu\.org/(?:licenses|copyleft)/fdl(?:\.html|\.txt)?
gfdl 20 gnu free documentation licen[cs]e
gpl-exception-classpath 85 linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-exception-classpath 60 with classpath-exception-2\.0
gpl-exception-gcc 60 with gcc-exception-(?:2\.0|3\.1)
gpl-exception-gcc 30 gcc runtime library exception
gpl-exception-bison 60 with bison-exception-2\.2
gpl-exception-linking 85 as a special exception, the copyright holders of this library give you permission to link this library with independent modules
gpl-exception-llvm 60 with llvm-exception
gpl-exception-autoconf 60 with autoconf-exception-(?:2\.0|3\.0)
# weak copyleft
mpl-1 95 spdx-license-identifier: \(?mpl-1\.0
mpl-1.1 95 spdx-license-identifier: \(?mpl-1\.1
mpl-1.1 85 the contents of this file are subject to the mozilla public licen[cs]e,? version 1\.1
mpl-1.1 80 mozilla\.org/mpl/mpl-1\.1(?:\.html|\.txt)?
mpl-1.1 30 (?:mozilla public licen[cs]e|mpl),? ?(?:version |v\.? ?)?1\.1
mpl-2 95 spdx-license-identifier: \(?mpl-2\.0(?:-no-copyleft-exception)?
mpl-2 90 mozilla public licen[cs]e version 2\.0 =* ?1\. definitions
mpl-2 85 this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0
mpl-2 85 if a copy of the mpl was not distributed with this file, you can obtain one at
mpl-2 80 mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-2 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
mpl-2 50 licen[cs]e ?[:=] ?['"]?mpl[- ]?v?2(?:\.0)?
mpl-2 30 (?:mozilla public licen[cs]e|mpl),? ?(?:version |v\.? ?)?2(?:\.0)?
mpl 20 mozilla public licen[cs]e
epl-1 95 spdx-license-identifier: \(?epl-1\.0
epl-1 85 made available under the terms of the eclipse public licen[cs]e v1\.0 which accompanies this distribution
epl-1 80 eclipse\.org/legal/epl-v10(?:\.html)?
epl-1 30 (?:eclipse public licen[cs]e|epl),?(?: -)? ?(?:version |v\.? ?)?1(?:\.0)?
epl-2 95 spdx-license-identifier: \(?epl-2\.0
epl-2 85 made available under the terms of the eclipse public licen[cs]e 2\.0 which is available at
epl-2 80 eclipse\.org/legal/epl-(?:2\.0|v20)(?:\.html)?
epl-2 30 (?:eclipse public licen[cs]e|epl),?(?: -)? ?(?:version |v\.? ?)?2(?:\.0)?
epl 20 eclipse public licen[cs]e
edl-1 30 eclipse distribution licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
cpl-1 95 spdx-license-identifier: \(?cpl-1\.0
cpl-1 30 common public licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
ipl-1 30 ibm public licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
cddl-1 95 spdx-license-identifier: \(?cddl-1\.0
cddl-1 85 the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl-1 80 opensource\.org/licenses?/cddl-1\.0(?:\.php)?
cddl-1 30 common development and distribution licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
cddl-1.1 95 spdx-license-identifier: \(?cddl-1\.1
cddl-1.1 30 common development and distribution licen[cs]e,? (?:version |v\.? ?)?1\.1
eupl-1.1 95 spdx-license-identifier: \(?eupl-1\.1
eupl-1.1 30 (?:european union public licen[cs]e|eupl),? ?(?:version |v\.? ?)?1\.1
eupl-1.2 95 spdx-license-identifier: \(?eupl-1\.2
eupl-1.2 85 licensed under the eupl,? version 1\.2 or
eupl-1.2 80 joinup\.ec\.europa\.eu/.{0,60}eupl
eupl-1.2 30 (?:european union public licen[cs]e|eupl),? ?(?:version |v\.? ?)?1\.2
eupl 20 european union public licen[cs]e
cecill-2.1 95 spdx-license-identifier: \(?cecill-2\.1
cecill-b 95 spdx-license-identifier: \(?cecill-b
cecill-c 95 spdx-license-identifier: \(?cecill-c
cecill-b 30 cecill-b(?: licen[cs]e)?
cecill-c 30 cecill-c(?: licen[cs]e)?
cecill 85 this software is governed by the cecill(?:-[bc])? licen[cs]e under french law
cecill 20 cecill(?: free software)? licen[cs]e
osl-3 95 spdx-license-identifier: \(?osl-3\.0
osl-3 85 licensed under the open software licen[cs]e version 3\.0
osl-3 30 open software licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?
rpl-1.5 30 reciprocal public licen[cs]e,? (?:version |v\.? ?)?1\.5
ms-pl 95 spdx-license-identifier: \(?ms-pl
ms-pl 90 this license governs use of the accompanying software\. if you use the software, you accept this license
ms-pl 30 (?:microsoft public licen[cs]e|ms-pl)
ms-rl 95 spdx-license-identifier: \(?ms-rl
ms-rl 30 (?:microsoft reciprocal licen[cs]e|ms-rl)
apsl-2 95 spdx-license-identifier: \(?apsl-2\.0
apsl-2 30 apple public source licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
npl-1.1 30 netscape public licen[cs]e(?:,? (?:version |v\.? ?)?1\.[01])?
spl-1 30 sun public licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
qpl-1 95 spdx-license-identifier: \(?qpl-1\.0
qpl-1 30 (?:q public licen[cs]e|qpl),? (?:version |v\.? ?)?1(?:\.0)?
# languages, libraries, products
artistic-1 95 spdx-license-identifier: \(?artistic-1\.0(?:-perl|-cl8)?
artistic-1 90 the intent of this document is to state the conditions under which a package may be copied
artistic-2 95 spdx-license-identifier: \(?artistic-2\.0
artistic-2 90 this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
artistic-2 80 perlfoundation\.org/artistic[-_]licen[cs]e[-_]2[._]0
artistic-2 30 artistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
artistic-1 20 artistic licen[cs]e
perl 85 free software; you (?:can|may) redistribute it and/or modify it under the same terms as perl(?: 5)?(?: itself)?
perl 70 (?:(?:licensed|released|distributed|available|provided) )?under the same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)?(?: itself)?
python-2 95 spdx-license-identifier: \(?(?:psf|python)-2\.0
python-2 90 this license agreement is between the python software foundation \("psf"\)
python-2 80 docs\.python\.org/3/license(?:\.html)?
python-2 30 (?:python software foundation|psf) licen[cs]e(?:,? (?:version |v\.? ?)?2)?
zpl-2.1 95 spdx-license-identifier: \(?zpl-2\.1
zpl-2.1 30 zope public licen[cs]e(?: \(zpl\))?(?:,? (?:version |v\.? ?)?2\.1)?
php-3 95 spdx-license-identifier: \(?php-3\.0
php-3.01 95 spdx-license-identifier: \(?php-3\.01
php-3.01 85 this source file is subject to version 3\.01 of the php licen[cs]e
php-3.01 80 php\.net/license/3_01\.txt
php-3.01 30 php licen[cs]e,? (?:version |v\.? ?)?3\.01
php-3 30 php licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?
ruby 95 spdx-license-identifier: \(?ruby
ruby 90 you may make and give away verbatim copies of the source form of the software without restriction
ruby 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:same )?terms (?:of|as) ruby
ruby 30 ruby(?:'s)? licen[cs]e
tcl 95 spdx-license-identifier: \(?tcl
tcl 90 the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose
tcl 30 tcl(?:/tk)? licen[cs]e
lppl-1.3c 95 spdx-license-identifier: \(?lppl-1\.3[ac]
lppl-1.3c 85 distributed and/or modified under the conditions of the latex project public licen[cs]e
lppl 80 latex-project\.org/lppl
lppl 20 latex project public licen[cs]e
openssl 95 spdx-license-identifier: \(?openssl
openssl 90 this product includes software developed by the openssl project for use in the openssl toolkit
openssl 30 openssl licen[cs]e
ssleay 90 this product includes cryptographic software written by eric young
postgresql 95 spdx-license-identifier: \(?postgresql
postgresql 90 permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
postgresql 30 postgresql licen[cs]e
zlib 95 spdx-license-identifier: \(?zlib
zlib 90 the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib 90 altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib 80 opensource\.org/licenses?/zlib(?:-license)?(?:\.php)?
zlib 50 licen[cs]e ?[:=] ?['"]?zlib
zlib 30 zlib(?:/libpng)? licen[cs]e
libpng 95 spdx-license-identifier: \(?libpng(?:-2\.0)?
libpng 90 permission is hereby granted to use, copy, modify, and distribute this source code, or portions hereof, for any purpose, without fee, subject to the following restrictions
libpng 30 libpng licen[cs]e
bzip2-1.0.6 95 spdx-license-identifier: \(?bzip2-1\.0\.[56]
ijg 95 spdx-license-identifier: \(?ijg
ijg 90 this software is based in part on the work of the independent jpeg group
freetype 95 spdx-license-identifier: \(?ftl
freetype 90 portions of this software are copyright .{1,20}? the freetype project
freetype 30 freetype(?: project)? licen[cs]e
boost-1 95 spdx-license-identifier: \(?bsl-1\.0
boost-1 90 permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
boost-1 85 distributed under the boost software licen[cs]e,? version 1\.0
boost-1 80 boost\.org/license_1_0\.txt
boost-1 30 boost software licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
icu 95 spdx-license-identifier: \(?icu
unicode 95 spdx-license-identifier: \(?unicode-(?:dfs-2015|dfs-2016|tou|3\.0)
unicode 30 unicode,? inc\.? licen[cs]e agreement
w3c 95 spdx-license-identifier: \(?w3c(?:-19980720|-20150513)?
w3c 80 w3\.org/consortium/legal/.{0,40}copyright-software
w3c 30 w3c(?: software)?(?: notice and)? licen[cs]e
vim 95 spdx-license-identifier: \(?vim
vim 30 vim licen[cs]e
imagemagick 95 spdx-license-identifier: \(?imagemagick
json 95 spdx-license-identifier: \(?json
json 90 the software shall be used for good, not evil
intel 95 spdx-license-identifier: \(?intel
nvidia 30 nvidia (?:software|source code) licen[cs]e
oracle-bcl 30 oracle binary code licen[cs]e agreement
upl-1 95 spdx-license-identifier: \(?upl-1\.0
upl-1 80 oss\.oracle\.com/licenses/upl
upl-1 30 universal permissive licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
blueoak-1 95 spdx-license-identifier: \(?blueoak-1\.0\.0
blueoak-1 30 blue oak model licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0){0,2})?
mulan-2 95 spdx-license-identifier: \(?mulanpsl-2\.0
mulan-2 30 mulan (?:permissive software licen[cs]e|psl),? ?(?:version |v\.? ?)?2
# source available
sspl-1 95 spdx-license-identifier: \(?sspl-1\.0
sspl-1 30 server side public licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
busl-1.1 95 spdx-license-identifier: \(?busl-1\.1
busl-1.1 30 business source licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
elastic-2 95 spdx-license-identifier: \(?elastic-2\.0
elastic-2 30 elastic licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
commons-clause 90 "commons clause" licen[cs]e condition v1\.0
commons-clause 30 commons clause
polyform-noncommercial 30 polyform noncommercial licen[cs]e(?: 1\.0\.0)?
confluent 30 confluent community licen[cs]e(?: agreement)?
llama-2 30 llama 2 community licen[cs]e(?: agreement)?
llama-3 30 (?:meta )?llama 3(?:\.[123])? community licen[cs]e(?: agreement)?
openrail-m 30 (?:creativeml |bigscience )?open ?rail(?:\+\+)?-m(?: licen[cs]e)?
bigscience-rail 30 bigscience rail licen[cs]e
# public domain
unlicense 95 spdx-license-identifier: \(?unlicense
unlicense 90 this is free and unencumbered software released into the public domain
unlicense 80 unlicense\.org
unlicense 50 licen[cs]e ?[:=] ?['"]?unlicense
unlicense 30 (?:the )?unlicense
cc0 95 spdx-license-identifier: \(?cc0-1\.0
cc0 90 to the extent possible under law, .{1,80}? has waived all copyright and related or neighboring rights
cc0 80 creativecommons\.org/publicdomain/zero/1\.0
cc0 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?(?: licen[cs]e)?
cc0 50 licen[cs]e ?[:=] ?['"]?cc0(?:-1\.0)?
cc0 30 (?:cc0|creative commons zero)(?:[- ]1\.0)?(?: universal)?
public-domain 80 creativecommons\.org/publicdomain/mark/1\.0
public-domain 70 (?:placed|released|dedicated|put|donated) (?:in|into|to) the public domain
public-domain 70 (?:is|are) (?:hereby )?in the public domain
public-domain 20 public domain
pddl-1 95 spdx-license-identifier: \(?pddl-1\.0
pddl-1 30 public domain dedication and licen[cs]e
us-government 85 this (?:is a )?work of the (?:u\.s\.|united states) government
# Creative Commons and data
cc-by-1 95 spdx-license-identifier: \(?cc-by-1\.0
cc-by-2 95 spdx-license-identifier: \(?cc-by-2\.[05]
cc-by-3 95 spdx-license-identifier: \(?cc-by-3\.0(?:-[a-z]{2})?
cc-by-4 95 spdx-license-identifier: \(?cc-by-4\.0
cc-by-sa 95 spdx-license-identifier: \(?cc-by-sa-[1-4]\.[05]
cc-by-nd 95 spdx-license-identifier: \(?cc-by-nd-[1-4]\.[05]
cc-by-nc 95 spdx-license-identifier: \(?cc-by-nc-[1-4]\.[05]
cc-by-nc-sa 95 spdx-license-identifier: \(?cc-by-nc-sa-[1-4]\.[05]
cc-by-nc-nd 95 spdx-license-identifier: \(?cc-by-nc-nd-[1-4]\.[05]
cc-by 80 creativecommons\.org/licenses/by/[1-4]\.[05]
cc-by-sa 80 creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-nd 80 creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-nc 80 creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nc-sa 80 creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc-nd 80 creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc-by 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:a |the )?(?:terms of )?(?:a |the )?creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)? licen[cs]e
cc-by-sa 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:a |the )?(?:terms of )?(?:a |the )?creative commons attribution[- ]share-?alike(?: [1-4]\.[05])?
cc-by-nc 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:a |the )?(?:terms of )?(?:a |the )?creative commons attribution[- ]non-?commercial(?: [1-4]\.[05])?
cc-by-nd 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:a |the )?(?:terms of )?(?:a |the )?creative commons attribution[- ]no-?deriv(?:ative)?s(?: [1-4]\.[05])?
cc-by-sa 50 licen[cs]e ?[:=] ?['"]?cc[- ]by[- ]sa(?:[- ][1-4]\.[05])?
cc-by-nc 50 licen[cs]e ?[:=] ?['"]?cc[- ]by[- ]nc(?:[- ][1-4]\.[05])?
cc-by 50 licen[cs]e ?[:=] ?['"]?cc[- ]by(?:[- ][1-4]\.[05])?
cc-by-sa 30 creative commons attribution[- ]share-?alike(?: [1-4]\.[05])?(?: international| unported)?
cc-by-nc 30 creative commons attribution[- ]non-?commercial(?: [1-4]\.[05])?(?: international| unported)?
cc-by-nc-sa 30 creative commons attribution[- ]non-?commercial[- ]share-?alike(?: [1-4]\.[05])?(?: international| unported)?
cc-by-nc-nd 30 creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s(?: [1-4]\.[05])?(?: international| unported)?
cc-by-nd 30 creative commons attribution[- ]no-?deriv(?:ative)?s(?: [1-4]\.[05])?(?: international| unported)?
cc-by 30 creative commons attribution(?: [1-4]\.[05])?(?: international| unported)?
cc-by-nc-nd 30 cc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.[05])?
cc-by-nc-sa 30 cc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.[05])?
cc-by-nc 30 cc[- ]by[- ]nc(?:[- ][1-4]\.[05])?
cc-by-nd 30 cc[- ]by[- ]nd(?:[- ][1-4]\.[05])?
cc-by-sa 30 cc[- ]by[- ]sa(?:[- ][1-4]\.[05])?
cc-by 30 cc[- ]by[- ][1-4]\.[05]
odbl 95 spdx-license-identifier: \(?odbl-1\.0
odbl 80 opendatacommons\.org/licenses/odbl
odbl 30 open (?:data commons open )?database licen[cs]e(?: \(odbl\))?
odc-by-1 95 spdx-license-identifier: \(?odc-by-1\.0
odc-by-1 80 opendatacommons\.org/licenses/by
odc-by-1 30 open data commons attribution licen[cs]e
cdla-permissive 95 spdx-license-identifier: \(?cdla-permissive-[12]\.0
cdla-sharing 95 spdx-license-identifier: \(?cdla-sharing-1\.0
cdla-permissive 30 community data licen[cs]e agreement[ –-]{1,3}permissive
cdla-sharing 30 community data licen[cs]e agreement[ –-]{1,3}sharing
ogl-3 95 spdx-license-identifier: \(?ogl-uk-3\.0
ogl-3 80 nationalarchives\.gov\.uk/doc/open-government-licen[cs]e/version/3
ogl-3 30 open government licen[cs]e(?:,? (?:version |v\.? ?)?3(?:\.0)?)?
etalab-2 95 spdx-license-identifier: \(?etalab-2\.0
free-art-1.3 30 (?:free art licen[cs]e|licence art libre)(?: 1\.3)?
# fonts
ofl-1.0 95 spdx-license-identifier: \(?ofl-1\.0
ofl-1.1 95 spdx-license-identifier: \(?ofl-1\.1(?:-rfn|-no-rfn)?
ofl-1.1 90 this font software is licensed under the sil open font licen[cs]e, version 1\.1
ofl-1.1 80 scripts\.sil\.org/ofl
ofl-1.1 70 (?:(?:licensed|released|distributed|available|provided) )?under (?:the )?(?:terms of )?(?:the )?(?:sil )?open font licen[cs]e
ofl-1.1 30 (?:sil )?open font licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
ubuntu-font-1 30 ubuntu font licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
bitstream-vera 90 bitstream vera is a trademark of bitstream
# not free
proprietary 85 all rights reserved\. (?:unauthorized|unauthorised) (?:copying|use|reproduction|distribution)
proprietary 85 this (?:software|document|material) is (?:the )?(?:confidential and proprietary|proprietary and confidential)
proprietary 50 licen[cs]e ?[:=] ?['"]?(?:proprietary|commercial|unlicensed)
evaluation 70 for evaluation (?:and|or) non-commercial (?:purposes|use) only
no-derivatives 50 no derivative works may be made
research-only 70 for (?:non-commercial )?research (?:purposes|use) only
"""
