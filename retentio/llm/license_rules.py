"""Signatures of licenses, written by hand.

One rule a line: rank, certainty in percent, keywords (all must be among a
text's words), pattern. The lines below a label are its rules. Patterns match
lower-case words with one space between: punctuation and signs are gone, so
"GPL-3.0" reads ``gpl 3 0``. A lower rank is a stronger rule; rules of equal
rank stand in the order of this file. Rank 0 rules are the base phrases, whose
places are always kept.
"""

RULES = """
cc-by
0 60 cc,by | cc by
gpl
0 70 general,public,license | general public license
reserved
0 40 reserved,rights | all rights reserved
mit
1 99 permission,sublicense | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}?sublicense and or sell
2 95 spdx,mit | spdx license identifier mit
2 92 mit,license | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit(?: x11)? licen[sc]e
3 85 mit,license | (?:the )?mit(?: x11| expat)? licen[sc]e
3 85 opensource,mit | opensource org licenses? mit
4 70 mit,licensed | licensed under (?:the )?mit
mit-0
2 95 spdx,mit | spdx license identifier mit 0
2 92 mit,attribution | mit no attribution
x11
2 90 x11,license | x11 licen[sc]e
apache-2.0
1 99 apache,compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance
2 95 spdx,apache | spdx license identifier apache 2 0
2 94 apache,license | apache license (?:version |v)?2 0
2 92 apache | apache 2 0
3 88 apache,licenses | apache org licenses license 2 0
3 80 apache,license | apache (?:software )?license
4 60 apache,licensed | licensed under (?:the )?apache
apache-1.1
2 94 apache | apache (?:software )?licen[sc]e (?:version )?1 1
2 95 spdx,apache | spdx license identifier apache 1 1
apache-1.0
2 94 apache | apache (?:software )?licen[sc]e (?:version )?1 0
2 95 spdx,apache | spdx license identifier apache 1 0
gpl-1.0
2 93 gnu,general | gnu general public licen[sc]e (?:as published by the free software foundation (?:either )?)?version 1
2 95 spdx,gpl | spdx license identifier gpl 1 0(?: only| or later)?
2 90 gpl | gpl ?(?:v|version )?1(?: 0)?
gpl-2.0
1 98 general,gnu,redistribute | redistribute it and or modify it under the terms of the gnu general public license .{0,80}?version 2
2 95 spdx,gpl | spdx license identifier gpl 2 0(?: only| or later)?
2 93 gnu,general | gnu general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version |v)?2
2 90 gpl | gpl (?:v|version )?2(?: 0)?(?: only| or later)?
2 90 gplv2 | gplv2(?: 0)?
2 90 gpl2 | gpl2
gpl-3.0
1 98 general,gnu,redistribute | redistribute it and or modify it under the terms of the gnu general public license .{0,80}?version 3
2 95 spdx,gpl | spdx license identifier gpl 3 0(?: only| or later)?
2 93 gnu,general | gnu general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version |v)?3
2 90 gpl | gpl (?:v|version )?3(?: 0)?(?: only| or later)?
2 90 gplv3 | gplv3(?: 0)?
2 90 gpl3 | gpl3
gpl-unversioned
3 80 gnu,general | gnu general public licen[sc]e
3 75 gnu,gpl | gnu gpl
3 70 gpl | gpl licen[sc]ed?
4 60 gpl,under | under (?:the )?gpl
lgpl-2.0
2 95 spdx,lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
2 93 gnu,library | gnu library general public licen[sc]e(?: version 2)?
lgpl-2.1
1 98 gnu,lesser,modify | modify it under the terms of the gnu lesser general public license .{0,80}?version 2 1
2 95 spdx,lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
2 93 gnu,lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version |v)?2 1
2 90 lgpl | lgpl (?:v|version )?2(?: 1)?
2 90 lgplv2 | lgplv2(?: 1)?
lgpl-3.0
2 95 spdx,lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
2 93 gnu,lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version |v)?3
2 90 lgpl | lgpl (?:v|version )?3(?: 0)?
2 90 lgplv3 | lgplv3(?: 0)?
lgpl-unversioned
3 80 lesser,general | (?:gnu )?lesser general public licen[sc]e
3 75 lgpl | (?:gnu )?lgpl
agpl-3.0
1 98 affero,modify | modify it under the terms of the gnu affero general public license .{0,80}?version 3
2 95 spdx,agpl | spdx license identifier agpl 3 0(?: only| or later)?
2 93 affero | gnu affero general public licen[sc]e(?: version 3| v3)?
2 90 agpl | agpl (?:v|version )?3(?: 0)?
2 90 agplv3 | agplv3
3 75 agpl | agpl
agpl-1.0
2 93 affero | affero general public licen[sc]e version 1
gfdl-1.3
2 95 spdx,gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
2 93 documentation,free | gnu free documentation licen[sc]e version 1 3
gfdl-1.2
2 95 spdx,gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
2 93 documentation,free | gnu free documentation licen[sc]e version 1 2
gfdl
3 80 documentation,free | (?:gnu )?free documentation licen[sc]e
3 75 gfdl | gfdl
gcc-exception
2 92 gcc,exception | gcc runtime library exception
classpath-exception
2 92 classpath,exception | classpath (?:linking )?exception
linking-exception
2 85 linking,exception | (?:static |dynamic )?linking exception
bsd-2-clause
1 98 disclaimer,redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 95 spdx,bsd | spdx license identifier bsd 2 clause
2 92 bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?
2 92 simplified,bsd | simplified bsd(?: licen[sc]e)?
2 92 freebsd,license | freebsd licen[sc]e
bsd-3-clause
1 98 endorse,promote | neither the name of .{1,120}? may be used to endorse or promote products derived from this software
2 95 spdx,bsd | spdx license identifier bsd 3 clause
2 92 bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
2 92 bsd,new | new bsd(?: licen[sc]e)?
2 92 bsd,modified | modified bsd(?: licen[sc]e)?
2 92 bsd,revised | revised bsd(?: licen[sc]e)?
bsd-4-clause
1 98 advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
2 95 spdx,bsd | spdx license identifier bsd 4 clause
2 92 bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
0bsd
2 95 0bsd | (?:spdx license identifier )?0bsd
2 92 bsd,zero | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
bsd-unversioned
3 78 bsd,license | bsd(?: style)? licen[sc]e
4 60 bsd,under | under (?:the |a )?bsd
bsl-1.0
1 98 executable,machine | in the form of machine executable object code generated by a source language processor
2 95 spdx,bsl | spdx license identifier bsl 1 0
2 92 boost,license | boost software licen[sc]e(?: version)?(?: 1 0)?
busl-1.1
2 95 spdx,busl | spdx license identifier busl 1 1
2 92 business,source | business source licen[sc]e(?: 1 1)?
mpl-2.0
1 98 mozilla,subject | this source code form is subject to the terms of the mozilla public license v 2 0
2 95 spdx,mpl | spdx license identifier mpl 2 0
2 92 mozilla,license | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
2 90 mpl | mpl (?:v|version )?2(?: 0)?
mpl-1.1
2 95 spdx,mpl | spdx license identifier mpl 1 1
2 92 mozilla,license | mozilla public licen[sc]e (?:version |v )?1 1
2 90 mpl | mpl (?:v|version )?1 1
mpl-1.0
2 92 mozilla,license | mozilla public licen[sc]e (?:version |v )?1 0
mpl-unversioned
3 78 mozilla,license | mozilla public licen[sc]e
epl-2.0
2 95 spdx,epl | spdx license identifier epl 2 0
2 92 eclipse,license | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
2 90 epl | epl (?:v|version )?2(?: 0)?
epl-1.0
2 95 spdx,epl | spdx license identifier epl 1 0
2 92 eclipse,license | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
2 90 epl | epl (?:v|version )?1(?: 0)?
epl-unversioned
3 78 eclipse,license | eclipse public licen[sc]e
edl-1.0
2 92 eclipse,distribution | eclipse distribution licen[sc]e(?: v ?1 0)?
cddl-1.0
2 95 spdx,cddl | spdx license identifier cddl 1 0
2 92 development,distribution | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1 0
2 90 cddl | cddl 1 0
cddl-1.1
2 95 spdx,cddl | spdx license identifier cddl 1 1
2 92 development,distribution | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1 1
2 90 cddl | cddl 1 1
cddl-unversioned
3 78 development,distribution | common development and distribution licen[sc]e
3 70 cddl | cddl
cpl-1.0
2 92 common,license | common public licen[sc]e(?: version| v)?(?: 1 0)?
ipl-1.0
2 92 ibm,license | ibm public licen[sc]e(?: version| v)?(?: 1 0)?
eupl-1.1
2 95 eupl | (?:spdx license identifier )?eupl (?:v ?)?1 1
eupl-1.2
2 95 eupl | (?:spdx license identifier )?eupl (?:v ?)?1 2
2 92 european,union | european union public licen[sc]e(?: v ?1 2)?
eupl-unversioned
3 75 eupl | eupl
cecill-2.1
2 93 cecill | cecill (?:v ?)?2 1
cecill-b
2 93 cecill | cecill b
cecill-c
2 93 cecill | cecill c
cecill
3 80 cecill | cecill(?: licen[sc]e)?
isc
1 98 permission,fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 95 spdx,isc | spdx license identifier isc
2 90 isc,license | isc licen[sc]e
ntp
2 90 ntp,license | ntp licen[sc]e
hpnd
2 90 historical,permission | historical permission notice and disclaimer
zlib
1 98 misrepresented,origin | the origin of this software must not be misrepresented
2 95 spdx,zlib | spdx license identifier zlib
2 90 zlib,license | zlib(?: libpng)? licen[sc]e
libpng
2 90 libpng,license | libpng licen[sc]e
unlicense
1 98 unencumbered,released | this is free and unencumbered software released into the public domain
2 95 spdx,unlicense | spdx license identifier unlicense
2 90 unlicense | (?:the )?unlicense
wtfpl
1 97 fuck,want | you just do what the fuck you want to
2 93 wtfpl | wtfpl
2 93 want,public | do what the fuck you want to public licen[sc]e
beerware
2 93 beerware | (?:the )?beerware licen[sc]e
2 90 beer,return | you can buy me a beer in return
public-domain
2 85 public,domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
3 70 public,domain | public domain
artistic-1.0
2 93 artistic | (?:spdx license identifier )?artistic (?:licen[sc]e )?1 0
artistic-2.0
2 93 artistic | (?:spdx license identifier )?artistic (?:licen[sc]e )?(?:version )?2 0
artistic
3 78 artistic,license | artistic licen[sc]e
perl
2 88 perl,terms | same terms as perl(?: itself)?
python-2.0
2 92 python,foundation | python software foundation licen[sc]e(?: version 2)?
2 92 psf,license | psf licen[sc]e
ruby
2 88 ruby,license | (?:the )?ruby licen[sc]e
php-3.01
2 92 php,license | php licen[sc]e(?: version)?(?: 3 01)?
openssl
1 97 openssl,project | this product includes software developed by the openssl project
2 90 openssl,license | openssl licen[sc]e
ssleay
2 90 ssleay | ssleay licen[sc]e
postgresql
2 92 postgresql,license | postgresql licen[sc]e
ncsa
2 92 ncsa,license | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
afl-3.0
2 92 academic,free | academic free licen[sc]e(?: version| v)?(?: 3 0)?
osl-3.0
2 92 open,software | open software licen[sc]e(?: version| v)?(?: 3 0)?
ofl-1.1
1 97 font,reserved | with reserved font name
2 95 spdx,ofl | spdx license identifier ofl 1 1
2 92 sil,font | sil open font licen[sc]e(?: version)?(?: 1 1)?
3 80 font,open | open font licen[sc]e
ms-pl
2 92 microsoft,public | microsoft public licen[sc]e
2 92 ms,pl | ms pl
ms-rl
2 92 microsoft,reciprocal | microsoft reciprocal licen[sc]e
upl-1.0
2 92 universal,permissive | universal permissive licen[sc]e(?: v ?1 0)?
vim
2 88 vim,license | vim licen[sc]e
ftl
2 92 freetype | freetype (?:project )?licen[sc]e
ijg
2 92 independent,jpeg | independent jpeg group
curl
2 88 curl,license | curl licen[sc]e
tcl
2 88 tcl,license | tcl(?: tk)? licen[sc]e
unicode
2 92 unicode,license | unicode(?: inc)? licen[sc]e(?: agreement)?
icu
2 90 icu,license | icu licen[sc]e
w3c
2 92 w3c,license | w3c(?: software)?(?: notice and)? licen[sc]e
mulan-psl-2.0
2 93 mulan | mulan psl v?2
zpl-2.1
2 92 zope,license | zope public licen[sc]e(?: version)?(?: 2 1)?
sleepycat
2 92 sleepycat | sleepycat licen[sc]e
qpl-1.0
2 92 public,license,q | q public licen[sc]e(?: version)?(?: 1 0)?
apsl-2.0
2 92 apple,source | apple public source licen[sc]e(?: version)?(?: 2 0)?
cpal-1.0
2 92 attribution,common | common public attribution licen[sc]e(?: version)?(?: 1 0)?
spl-1.0
2 92 sun,license | sun public licen[sc]e(?: version)?(?: 1 0)?
npl-1.1
2 92 netscape,license | netscape public licen[sc]e(?: version)?(?: 1 1)?
lppl-1.3c
2 92 latex,license | latex project public licen[sc]e(?: version)?(?: 1 3c?)?
sspl-1.0
2 93 side,server | server side public licen[sc]e(?: version| v)?(?: ?1)?
2 92 sspl | sspl(?: 1 0)?
elastic-2.0
2 92 elastic,license | elastic licen[sc]e(?: 2 0)?
commons-clause
2 93 clause,commons | commons clause(?: licen[sc]e condition)?
polyform
2 92 polyform | polyform (?:noncommercial|shield|perimeter|strict|small business|free trial)(?: licen[sc]e)?
parity
2 92 parity,license | parity public licen[sc]e
openrail
2 90 rail,license | (?:creativeml |bigscience )?(?:open )?rail(?: m)? licen[sc]e
2 90 openrail | openrail(?: m)?
llama-community
2 90 community,llama | llama (?:2 |3 )?community licen[sc]e
cc0-1.0
1 97 affirmer,waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
2 95 cc0 | (?:spdx license identifier )?cc0(?: 1 0)?(?: universal)?
2 92 creativecommons,zero | creativecommons org publicdomain zero 1 0
pddl
2 92 dedication,domain | public domain dedication and licen[sc]e
cc-by-4.0
2 95 by,cc | cc by 4 0
2 93 attribution,creative | creative commons attribution 4 0(?: international)?
2 92 by,creativecommons | creativecommons org licenses by 4 0
cc-by-3.0
2 95 by,cc | cc by 3 0
2 93 attribution,creative | creative commons attribution 3 0(?: unported)?
2 92 by,creativecommons | creativecommons org licenses by 3 0
cc-by-2.0
2 95 by,cc | cc by 2 [05]
2 93 attribution,creative | creative commons attribution 2 [05](?: generic)?
cc-by-sa-4.0
2 96 by,cc,sa | cc by sa 4 0
2 94 attribution,commons,creative | creative commons attribution share ?alike 4 0(?: international)?
2 92 creativecommons,sa | creativecommons org licenses by sa 4 0
cc-by-sa-3.0
2 96 by,cc,sa | cc by sa 3 0
2 94 attribution,commons,creative | creative commons attribution share ?alike 3 0(?: unported)?
2 92 creativecommons,sa | creativecommons org licenses by sa 3 0
cc-by-sa-2.0
2 96 by,cc,sa | cc by sa 2 [05]
cc-by-nc-4.0
2 96 by,cc,nc | cc by nc 4 0
2 94 attribution,commons,creative | creative commons attribution non ?commercial 4 0(?: international)?
2 92 creativecommons,nc | creativecommons org licenses by nc 4 0
cc-by-nc-3.0
2 96 by,cc,nc | cc by nc 3 0
2 94 attribution,commons,creative | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nd-4.0
2 96 by,cc,nd | cc by nd 4 0
2 94 attribution,commons,creative | creative commons attribution no ?derivatives 4 0(?: international)?
cc-by-nd-3.0
2 96 by,cc,nd | cc by nd 3 0
cc-by-nc-sa-4.0
2 97 by,cc,nc,sa | cc by nc sa 4 0
2 94 attribution,commons,creative | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
2 92 creativecommons,nc,sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0
2 97 by,cc,nc,sa | cc by nc sa 3 0
2 94 attribution,commons,creative | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-nd-4.0
2 97 by,cc,nc,nd | cc by nc nd 4 0
2 94 attribution,commons,creative | creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?
2 92 creativecommons,nc,nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0
2 97 by,cc,nc,nd | cc by nc nd 3 0
cc-by-nc-sa
3 85 by,cc,nc,sa | cc by nc sa
cc-by-nc-nd
3 85 by,cc,nc,nd | cc by nc nd
cc-by-sa
3 84 by,cc,sa | cc by sa
3 80 attribution | attribution share ?alike
cc-by-nc
3 84 by,cc,nc | cc by nc
3 80 attribution | attribution non ?commercial
cc-by-nd
3 84 by,cc,nd | cc by nd
3 80 attribution | attribution no ?derivatives
creative-commons
3 70 commons,creative | creative commons(?: licen[sc]e)?
4 60 creativecommons | creativecommons org
odbl-1.0
2 95 odbl | (?:spdx license identifier )?odbl(?: 1 0)?
2 92 database,open | open data(?:base)? (?:commons )?(?:open )?(?:database )?licen[sc]e
odc-by-1.0
2 95 by,odc | odc by(?: 1 0)?
ogl-uk-3.0
2 92 government,open | open government licen[sc]e(?: v ?3 0)?
cdla-permissive
2 92 cdla | cdla permissive(?: [12] 0)?
cdla-sharing
2 92 cdla | cdla sharing(?: 1 0)?
data-commons
3 70 commons,data | open data commons
proprietary
2 85 confidential,proprietary | proprietary and confidential
2 85 prohibited,unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|document|software|work) )?.{0,60}?(?:is )?strictly prohibited
3 70 without,written | without (?:the )?(?:express |prior )+written (?:permission|consent)
3 65 license,proprietary | proprietary licen[sc]e
commercial
3 65 commercial,license | commercial licen[sc]e
eula
3 70 agreement,user | end user licen[sc]e agreement
3 65 eula | eula
non-commercial
3 60 commercial,purposes | (?:for )?non ?commercial (?:use|purposes) only
personal-use
3 60 personal,use | for personal use only
dual-license
3 60 dual | dual licen[sc]ed?(?: under)?
copyright
4 45 copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
4 40 copyrighted | copyrighted (?:material|work)
4 40 copyleft | copyleft
license-mention
4 30 license,terms | see (?:the )?licen[sc]e (?:file )?for (?:details|terms|more information)
4 30 license,under | (?:licen[sc]ed|released) under (?:the )?(?:terms of )?(?:this|the|a|an) licen[sc]e
4 30 license,spdx | spdx license identifier [0-9a-z]+
"""
