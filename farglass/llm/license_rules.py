"""Ordered license signatures, as regular expressions over words with single spaces between them.

Each family gives one rule for each template; texts that stand for a license have rules of their
own. A rule has a priority (higher ones suppress detections inside theirs), a confidence and the
words that its matches must hold, which gate the expression; a gate ``a|b`` asks for either.
"""

from __future__ import annotations

from dataclasses import dataclass

#: label, gate word (or several with | between them, one of which every match holds), SPDX-like identifier in words, name pattern.
FAMILIES: tuple[tuple[str, str, str, str], ...] = (
    ("0bsd", "bsd", "0bsd", r"(?:0|zero clause) ?bsd"),
    ("aal", "attribution", "aal", r"attribution assurance"),
    ("afl-3", "academic", "afl 3 0", r"academic free(?: license)?(?: version| v)? 3(?: 0)?"),
    ("agpl-3", "agpl", "agpl 3 0(?: only| or later)?", r"(?:gnu )?agpl ?v?3?(?: 0)?"),
    ("agpl-3", "affero", "agpl v3", r"(?:gnu )?affero general public(?: license)?(?: version| v)? ?3?(?: 0)?"),
    ("apache-1.1", "apache", "apache 1 1", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("apache-2", "apache", "apache 2 0", r"apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?"),
    ("apsl-2", "apple", "apsl 2 0", r"apple public source(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic-1", "artistic", "artistic 1 0", r"artistic(?: license)?(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic 2 0", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("blueoak-1", "oak", "blueoak 1 0 0", r"blue oak model(?: license)?(?: 1 0 0)?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", r"(?:bsd (?:2|two) clause|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:bsd (?:3|three) clause|(?:new|revised|modified) bsd)"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"(?:bsd (?:4|four) clause|original bsd)"),
    ("bsd", "bsd", "bsd", r"bsd(?: style)?"),
    ("bsl-1", "boost", "bsl 1 0", r"boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", "busl 1 1", r"business source(?: license)?(?: version)?(?: 1 1)?"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?", r"cc by(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by", "creative", "creative commons by", r"creative commons attribution(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-sa", "alike", "creative commons by sa", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-nc", "commercial", "creative commons by nc", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?"),
    ("cc0-1", "cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cddl-1", "cddl", "cddl 1 0", r"cddl(?: version| v)?(?: 1 [01])?"),
    ("cddl-1", "distribution", "cddl", r"common development and distribution(?: license)?(?: 1 [01])?"),
    ("cecill-2", "cecill", "cecill 2 [01]", r"cecill(?: [bc])?(?: v?2(?: [01])?)?"),
    ("cpl-1", "common", "cpl 1 0", r"common public(?: license)?(?: version)? 1(?: 0)?"),
    ("ecl-2", "educational", "ecl 2 0", r"educational community(?: license)?(?: version)? 2(?: 0)?"),
    ("efl-2", "eiffel", "efl 2 0", r"eiffel forum(?: license)?(?: version)? 2"),
    ("epl-1", "eclipse", "epl 1 0", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "epl 2 0", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl 1 2", r"eupl(?: version| v)?(?: 1 [12])?"),
    ("gfdl", "documentation", "gfdl 1 [1-3](?: only| or later)?", r"(?:gnu )?free documentation(?: license)?(?: version 1 [1-3])?"),
    ("gpl-1", "gpl", "gpl 1 0(?: only| or later)?", r"(?:gnu )?gpl ?v?1(?: 0)?"),
    ("gpl-2", "gpl", "gpl 2 0(?: only| or later)?", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl", "gpl 3 0(?: only| or later)?", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", "gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2", "gnu", "gnu gpl v2", r"gnu general public(?: license)?(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3", "gnu", "gnu gpl v3", r"gnu general public(?: license)?(?: version| v)? ?v?3(?: 0)?"),
    ("hpnd", "historical", "hpnd", r"historical permission notice(?: and disclaimer)?"),
    ("ijg", "jpeg", "ijg", r"independent jpeg group"),
    ("ipl-1", "ibm", "ipl 1 0", r"ibm public(?: license)?(?: version)?(?: 1 0)?"),
    ("isc", "isc", "isc", r"isc"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?lgpl(?: version)? ?v?2(?: 1)?"),
    ("lgpl-3", "lgpl", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", "gnu lgpl", r"(?:gnu )?lesser general public(?: license)?(?: version| v)? ?v?2(?: 1)?"),
    ("lppl-1.3", "latex", "lppl 1 3c?", r"latex project public(?: license)?(?: version)?(?: 1 3c?)?"),
    ("mit", "mit", "mit", r"(?:the )?mit(?: x11| expat)?"),
    ("mit-0", "mit", "mit 0", r"mit (?:0|no attribution)"),
    ("mpl-1.1", "mozilla|mpl", "mpl 1 1", r"(?:mozilla public|mpl)(?: license)?(?: version| v)? ?1(?: 1)?"),
    ("mpl-2", "mozilla|mpl", "mpl 2 0", r"(?:mozilla public|mpl)(?: license)?(?: version| v)? ?v?2(?: 0)?"),
    ("ms-pl", "microsoft", "ms pl", r"microsoft public"),
    ("ms-rl", "microsoft", "ms rl", r"microsoft reciprocal"),
    ("mulan-2", "mulan", "mulanpsl 2 0", r"mulan permissive software(?: license)?(?: version| v)? ?2?"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1", "database", "odbl 1 0", r"open (?:data commons open )?database(?: license)?(?: 1 0)?"),
    ("ofl-1.1", "font", "ofl 1 1", r"(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?"),
    ("openssl", "openssl", "openssl", r"openssl"),
    ("osl-3", "open software|osl", "osl 3 0", r"(?:open software|osl)(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("php-3", "php", "php 3 01?", r"php(?: license)?(?: version| v)? ?3(?: 01?)?"),
    ("postgresql", "postgresql", "postgresql", r"postgresql"),
    ("psf-2", "python", "python 2 0", r"python(?: software foundation)?(?: 2 0)?"),
    ("ruby", "ruby", "ruby", r"ruby"),
    ("sspl-1", "server", "sspl 1 0", r"server side public(?: license)?(?: version)?(?: 1)?"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1", "universal", "upl 1 0", r"universal permissive(?: license)?(?: version| v)?(?: 1 0)?"),
    ("vim", "vim", "vim", r"vim"),
    ("w3c", "w3c", "w3c", r"w3c(?: software)?(?: notice and)?"),
    ("wtfpl", "fuck|wtfpl", "wtfpl", r"(?:do what the fuck you want to public|wtfpl)"),
    ("x11", "x11", "x11", r"x11"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)?"),
    ("zpl-2.1", "zope", "zpl 2 1", r"zope public(?: license)?(?: version| v)?(?: 2 1)?"),
)

#: kind, priority, confidence, pattern ({i} identifier, {n} name).
TEMPLATES: tuple[tuple[str, int, float, str], ...] = (
    ("identifier", 4, 1.0, r"spdx licen[sc]e identifier {i}"),
    ("notice", 3, 0.95, r"licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[sc]e)?(?: version \d+(?: \d+)?)?"),
    ("release", 3, 0.9, r"(?:released|distributed|available|published|provided|shared|used) under (?:the )?(?:terms of )?(?:the )?{n} licen[sc]e(?: version \d+(?: \d+)?)?"),
    ("named", 2, 0.8, r"(?:the )?{n} (?:public )?licen[sc]e(?: version \d+(?: \d+)?)?"),
    ("field", 2, 0.85, r"licen[sc]e(?:s| type| name)? {n}"),
)

#: label, gate words, pattern: phrases of license texts and of notices that point to them.
TEXTS: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("mit", ("hereby", "granted"), r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", ("hereby", "granted"), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", ("redistribution", "binary"), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", ("redistribute", "licen"), r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", ("redistribute", "lesser"), r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("apache-2", ("licen", "compliance"), r"you may not use this file except in compliance with the licen[sc]e"),
    ("mit", ("copyright", "portions"), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", ("warrant", "merchantability"), r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", ("copyright", "liable"), r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", ("copyright", "sublicense"), r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software(?: and to permit persons to whom the software is furnished to do so)? subject to the following conditions the above copyright notice"),
    ("isc", ("warrant", "disclaims"), r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("curl", ("hereby", "copyright"), r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("ntp", ("hereby", "documentation"), r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", ("hereby", "documentation"), r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", ("hereby", "agreement"), r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", ("hereby", "licen"), r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose"),
    ("w3c", ("hereby", "royalty"), r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("w3c", ("copyright", "licen"), r"this work is being provided by the copyright holders under the following licen[sc]e"),
    ("x11", ("consortium", "warrant"), r"express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the x consortium be liable"),
    ("ncsa", ("hereby", "restriction"), r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("mit", ("hereby", "restriction"), r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsl-1", ("hereby", "organization"), r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("unicode", ("hereby", "unicode"), r"permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files"),
    ("ofl-1.1", ("hereby", "font"), r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("bsd", ("redistribut", "copyright"), r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", ("redistribut", "reproduce"), r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", ("copyright", "contributors"), r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", ("disclaimed", "warrant"), r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-2-clause", ("copyright", "views"), r"either expressed or implied of the copyright holders? the views and conclusions contained in the software"),
    ("bsd-3-clause", ("endorse", "permission", "copyright"), r"neither the names? of (?:the )?copyright holders? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", ("advertising", "redistribut"), r"redistributions? (?:\S+ ){0,20}all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", ("licen", "unless"), r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", ("licen", "governing"), r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2", ("licen", "apache"), r"you may obtain a copy of the licen[sc]e at https? www apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2", ("licen", "contributor"), r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2", ("hereby", "irrevocable"), r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[sc]e"),
    ("gpl", ("redistribute", "program"), r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2", ("licen", "version 2"), r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3", ("licen", "version 3"), r"either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl", ("warrant", "hope"), r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", ("licen", "received"), r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|file|software)"),
    ("lgpl", ("licen", "received"), r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:program|library|software)"),
    ("agpl-3", ("licen", "received"), r"you should have received a copy of the gnu affero general public licen[sc]e along with this program"),
    ("gpl", ("licen", "verbatim"), r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl-2", ("licen", "freedom"), r"the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", ("copyleft", "licen"), r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("agpl-3", ("copyleft", "affero"), r"the gnu affero general public licen[sc]e is a free copyleft licen[sc]e"),
    ("gpl-2", ("licen", "version 2"), r"under the terms of the gnu general public licen[sc]e version 2 only"),
    ("gpl", ("warrant", "extent"), r"there is no warranty for the program to the extent permitted by applicable law"),
    ("lgpl-2.1", ("licen", "version 2 1"), r"either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl", ("redistribute", "library"), r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", ("warrant", "library"), r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gfdl", ("licen", "documentation"), r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", ("licen", "invariant"), r"published by the free software foundation with no invariant sections no front cover texts and no back cover texts a copy of the licen[sc]e"),
    ("mpl-2", ("licen", "mozilla"), r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-1.1", ("licen", "mozilla"), r"the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]"),
    ("mpl-1.1", ("licen", "basis"), r"software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e for the specific language governing rights"),
    ("epl-1", ("licen", "accompanying"), r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?1 0"),
    ("epl-2", ("licen", "accompanying"), r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v ?)?2 0"),
    ("epl-1", ("licen", "eclipse"), r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("cpl-1", ("licen", "agreement"), r"the accompanying program is provided under the terms of this common public licen[sc]e agreement"),
    ("cddl-1", ("licen", "distribution"), r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("zlib", ("warrant", "liable"), r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", ("redistribute", "alter "), r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely(?: subject to the following restrictions 1 the origin of this software must not be misrepresented)?"),
    ("unlicense", ("domain", "unencumbered"), r"this is free and unencumbered software released into the public domain"),
    ("unlicense", ("domain", "dedicate"), r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", ("copyright", "relinquishment"), r"overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("cc0-1", ("domain", "deed"), r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1", ("copyright", "waived"), r"to the extent possible under law (?:\S+ ){1,8}(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by", ("licen", "creative"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc-by-sa", ("licen", "alike"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc-by-nc", ("licen", "commercial"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc-by-nd", ("licen", "deriv"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc-by-nc-sa", ("licen", "alike"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc-by-nc-nd", ("licen", "deriv"), r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] 0 )?(?:international |unported )?licen[sc]e"),
    ("cc", ("redistribute", "medium"), r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc", ("licen", "credit"), r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", ("licen", "contributions"), r"if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original"),
    ("cc", ("licen", "legalcode"), r"creativecommons org licen[sc]es (?:\S+ ){1,4}legalcode"),
    ("cc-by", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by [1-4] 0"),
    ("cc-by-sa", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by sa [1-4] 0"),
    ("cc-by-nc", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by nc [1-4] 0"),
    ("cc-by-nd", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by nd [1-4] 0"),
    ("cc-by-nc-sa", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by nc sa [1-4] 0"),
    ("cc-by-nc-nd", ("licen", "creativecommons"), r"creativecommons org licen[sc]es by nc nd [1-4] 0"),
    ("cc0-1", ("creative", "publicdomain"), r"creativecommons org publicdomain zero 1 0"),
    ("wtfpl", ("licen", "verbatim"), r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document"),
    ("artistic-1", ("copyright", "package"), r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", ("licen", "package"), r"this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("psf-2", ("licen", "python"), r"this licen[sc]e agreement is between the python software foundation psf and the individual or organization"),
    ("psf-2", ("hereby", "psf"), r"psf hereby grants licen[sc]ee a nonexclusive royalty free world ?wide licen[sc]e"),
    ("ofl-1.1", ("licen", "font"), r"this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("ofl-1.1", ("licen", "derivatives"), r"the fonts and derivatives however cannot be released under any other type of licen[sc]e"),
    ("php-3", ("redistribut", "php"), r"redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment this product includes php software"),
    ("openssl", ("redistribut", "openssl"), r"redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment this product includes software developed by the openssl project"),
    ("ruby", ("copyright", "ruby"), r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("vim", ("licen", "vim"), r"no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text"),
    ("freetype", ("copyright", "freetype"), r"portions of this software are copyright (?:\S+ ){0,4}the freetype project"),
    ("beerware", ("licen", "beer"), r"the beer ?ware licen[sc]e"),
    ("json", ("copyright", "evil"), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software shall be used for good not evil"),
    ("sspl-1", ("licen", "service"), r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available via network download to everyone at no charge under the terms of this licen[sc]e"),
    ("busl-1.1", ("hereby", "production"), r"the licen[sc]or hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[sc]ed work"),
    ("busl-1.1", ("licen", "change date"), r"effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licen[sc]ed work"),
    ("elastic-2", ("licen", "managed"), r"elastic licen[sc]e (?:\S+ ){0,40}you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", ("licen", "sell"), r"the licen[sc]e does not grant to you the right to sell the software"),
    ("polyform", ("licen", "polyform"), r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) licen[sc]e"),
    ("ms-pl", ("licen", "accompanying"), r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("eupl-1.2", ("licen", "compliance"), r"you may not use this work except in compliance with the licen[sc]e"),
    ("cecill-2", ("licen", "french"), r"this software is governed by the cecill (?:[bc] )?licen[sc]e under french law"),
    ("odbl-1", ("licen", "database"), r"this (?:\S+ ){1,4}(?:database )?is made available under the open database licen[sc]e"),
    ("odbl-1", ("licen", "contents"), r"any rights in individual contents of the database are licen[sc]ed under the database contents licen[sc]e"),
    ("pddl-1", ("domain", "dedication"), r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl-3", ("licen", "sector"), r"contains public sector information licen[sc]ed under the open government licen[sc]e(?: v3 0)?"),
    ("afl-3", ("licen", "academic"), r"licen[sc]ed under the academic free licen[sc]e version 3 0"),
    ("osl-3", ("licen", "open software"), r"licen[sc]ed under the open software licen[sc]e version 3 0"),
    ("us-gov", ("copyright", "government"), r"(?:is a )?works? of the (?:united states|u s) government and (?:is|are) not subject to (?:domestic )?copyright protection"),
    ("fair-use", ("copyright", "section 107"), r"copyright disclaimer under section 107(?: of the copyright act)?"),
    ("proprietary", ("prohibited", "copying"), r"unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", ("proprietary", "confidential"), r"(?:proprietary and confidential|confidential and proprietary information)"),
    ("proprietary", ("prohibited", "permission"), r"(?:reproduction|redistribution|copying|use) without (?:express |prior )?(?:written )?permission is (?:strictly )?prohibited"),
    ("proprietary", ("reserved", "reproduced"), r"all rights reserved no part of this (?:publication|book|document|work) may be reproduced"),
    ("eula", ("licen", "end user"), r"end user licen[sc]e agreement"),
    ("eula", ("licen", "transferable"), r"(?:grants?|granted) (?:to )?you a (?:\S+ ){0,4}non exclusive non transferable (?:\S+ ){0,3}licen[sc]e"),
    ("eula", ("disassemble", "reverse"), r"you may not (?:\S+ ){0,6}reverse engineer decompile or disassemble"),
    ("eula", ("licen", "you agree"), r"by (?:downloading|installing|copying)(?: or using)? (?:the|this) software you agree to (?:be bound by )?the terms of this licen[sc]e"),
    ("non-commercial", ("licen", "commercial"), r"licen[sc]ed for (?:personal and )?non ?commercial use only"),
    ("shareware", ("licen", "evaluation"), r"licen[sc]ed for evaluation purposes only"),
    ("no-redistribution", ("redistribut", "not be"), r"may not be (?:sold or )?redistributed(?: without (?:prior )?(?:written )?permission)?"),
    ("all-rights-reserved", ("reserved", "rights"), r"all rights reserved"),
    ("public-domain", ("domain",), r"(?:is|are|released (?:in)?to|dedicated to|placed in) (?:in )?the public domain"),
    ("cc", ("creative",), r"creative commons licen[sc]e"),
    ("proprietary", ("licen", "proprietary"), r"proprietary licen[sc]e"),
    ("copyleft", ("copyleft",), r"copyleft"),
)

#: label and phrase of the base signatures, every place of which counts.
BASE: tuple[tuple[str, str], ...] = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    confidence: float
    base: bool
    gates: tuple[str, ...]
    pattern: str


def build() -> list[Rule]:
    """All rules in order; earlier ones win where priority and interval are equal."""
    made: list[tuple] = [(label, 2, 0.9, True, tuple(phrase.split()), phrase) for label, phrase in BASE]
    made += [(label, 3, 0.9, False, gates, pattern) for label, gates, pattern in TEXTS]
    for _, priority, confidence, template in TEMPLATES:
        for label, gate, identifier, name in FAMILIES:
            gates = ("spdx",) if "spdx" in template else ("licen", gate)
            made.append((label, priority, confidence, False, gates, template.format(i=identifier, n=name)))
    # No word may go on beyond a match.
    return [Rule(k, label, p, c, base, gates, f"(?<= ){pattern}(?= )") for k, (label, p, c, base, gates, pattern) in enumerate(made)]
