"""Signature rules of the license scan, written one by one: label, keyword, rank, pattern.

Patterns run on the normal form (lower case, runs of other characters as one space) and stand between spaces. The keyword
is a word of every match. Rank 40: a grant or notice that names or is the license; 30: its characteristic clauses; 20: the
license named in full; 10: a tag or short name; 5: clauses that many licenses share.
"""

RULES = [
    # Permissive, short
    ("mit", "mit", 40, "(?:licensed|distributed|released|available|published|provided|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?mit licen[sc]e"),
    ("mit", "mit", 30, "(?:subject to|governed by|covered by|according to) (?:the )?(?:terms of (?:the )?)?mit licen[sc]e"),
    ("mit", "mit", 20, "(?:the )?mit (?:open source |software |style )?licen[sc]e"),
    ("mit", "mit", 10, "(?:spdx license identifier|licen[sc]e|licen[sc]e type|licensed) mit"),
    ("mit", "deal", 40, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", "sublicense", 30, "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 30, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "attribution", 20, "mit no attribution(?: licen[sc]e)?"),
    ("mit-0", "mit", 20, "mit 0(?: licen[sc]e)?"),
    ("mit-expat", "expat", 20, "(?:the )?expat licen[sc]e"),
    ("mit-expat", "expat", 10, "(?:licen[sc]e|licensed under) expat"),
    ("mit-advertising", "enlightenment", 20, "enlightenment licen[sc]e(?: e16)?"),
    ("x11", "x11", 20, "(?:the )?(?:mit )?x11 licen[sc]e"),
    ("x11", "consortium", 30, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "isc", 40, "(?:licensed|distributed|released|available) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e"),
    ("isc", "isc", 20, "(?:the )?isc licen[sc]e"),
    ("isc", "isc", 10, "(?:spdx license identifier|licen[sc]e) isc"),
    ("isc", "fee", 30, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "0bsd", 10, "(?:spdx license identifier|licen[sc]e) 0bsd"),
    ("0bsd", "0bsd", 20, "0bsd licen[sc]e"),
    ("0bsd", "zero", 20, "(?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?"),
    ("0bsd", "fee", 20, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "zlib", 20, "(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("zlib", "zlib", 10, "(?:spdx license identifier|licen[sc]e) zlib"),
    ("zlib", "misrepresented", 30, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 30, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "libpng", 20, "(?:the )?libpng licen[sc]e"),
    ("libpng", "png", 20, "(?:the )?png reference library licen[sc]e"),
    ("boost", "boost", 40, "(?:licensed|distributed|released) under (?:the )?(?:terms of (?:the )?)?boost software license(?: version 1 0)?"),
    ("boost", "boost", 20, "(?:the )?boost software license(?: version)?(?: 1 0)?"),
    ("boost", "bsl", 10, "(?:spdx license identifier|licen[sc]e) bsl 1 0"),
    ("boost", "executable", 30, "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("unlicense", "unlicense", 20, "(?:the )?unlicense"),
    ("unlicense", "unencumbered", 40, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", 20, "(?:the )?wtfpl(?: licen[sc]e)?(?: version 2)?"),
    ("wtfpl", "fuck", 20, "do what the fuck you want to public license"),
    ("beerware", "beer", 30, "you can buy me a beer in return"),
    ("beerware", "beerware", 20, "(?:the )?beerware licen[sc]e"),
    ("beerware", "beer", 20, "(?:the )?beer ware licen[sc]e"),
    ("curl", "curl", 20, "(?:the )?curl licen[sc]e"),
    ("ntp", "ntp", 20, "(?:the )?ntp licen[sc]e"),
    ("hpnd", "historical", 20, "historical permission notice and disclaimer"),
    ("ncsa", "ncsa", 20, "(?:the )?(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ncsa", "illinois", 20, "university of illinois open source licen[sc]e"),
    ("upl-1.0", "universal", 20, "universal permissive license(?: v 1 0| v1 0| version 1 0)?"),
    ("afl-3.0", "academic", 20, "academic free license(?: version| v)?(?: 3 0| 2 1)?"),
    ("ecl-2.0", "educational", 20, "educational community license(?: version)?(?: 2 0)?"),
    ("fair", "fair", 10, "spdx license identifier fair"),
    ("fair", "usage", 30, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("postgresql", "postgresql", 20, "(?:the )?postgresql licen[sc]e"),
    ("python-2.0", "python", 20, "(?:the )?python software foundation license(?: agreement)?(?: version 2| v2)?"),
    ("python-2.0", "psf", 10, "(?:spdx license identifier |licen[sc]e )?psf (?:2 0|licen[sc]e)"),
    ("cnri-python", "cnri", 20, "cnri (?:open source )?(?:python )?license(?: agreement)?"),
    ("ruby", "ruby", 20, "(?:the )?ruby licen[sc]e"),
    ("ruby", "ruby", 30, "(?:under|distributed under) the same terms as ruby"),
    ("perl", "perl", 30, "(?:under|distributed under) the same terms as perl(?: itself)?"),
    ("php-3.01", "php", 20, "(?:the )?php license(?: version)?(?: 3 01| 3 0)?"),
    ("zend-2.0", "zend", 20, "(?:the )?zend (?:engine )?licen[sc]e"),
    ("vim", "vim", 20, "(?:the )?vim licen[sc]e"),
    ("tcl", "tcl", 20, "(?:the )?tcl(?: tk)? licen[sc]e"),
    ("icu", "icu", 20, "(?:the )?icu licen[sc]e"),
    ("unicode", "unicode", 20, "unicode (?:inc )?license agreement(?: data files and software)?"),
    ("openssl", "openssl", 20, "(?:the )?openssl(?: ssleay)? licen[sc]e"),
    ("openssl", "openssl", 30, "this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", 30, "this product includes cryptographic software written by eric young"),
    ("imagemagick", "imagemagick", 20, "(?:the )?imagemagick licen[sc]e"),
    ("freetype", "freetype", 20, "(?:the )?freetype (?:project )?licen[sc]e"),
    ("ijg", "jpeg", 30, "this software is based in part on the work of the independent jpeg group"),
    ("w3c", "w3c", 20, "(?:the )?w3c software (?:notice and|and document) licen[sc]e"),
    ("json", "evil", 30, "the software shall be used for good not evil"),
    # BSD
    ("bsd-2-clause", "bsd", 20, "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", 20, "(?:the )?freebsd (?:copyright|licen[sc]e)"),
    ("bsd-2-clause", "bsd", 40, "(?:licensed|distributed|released|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e"),
    ("bsd-3-clause", "bsd", 20, "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", 40, "(?:licensed|distributed|released|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e"),
    ("bsd-3-clause", "endorse", 30, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "clear", 20, "(?:bsd 3 clause clear|clear bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", 20, "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "advertising", 30, "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-source-code", "bsd", 20, "bsd source code attribution"),
    ("bsd-protection", "bsd", 20, "bsd protection licen[sc]e"),
    ("bsd-3-clause", "edistribution", 10, "edistribution license v 1 0"),
    ("bsd", "bsd", 40, "(?:licensed|distributed|released|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:a )?bsd(?: style)? licen[sc]e"),
    ("bsd", "bsd", 20, "(?:the )?bsd(?: style| type)? licen[sc]e"),
    ("bsd", "bsd", 10, "licen[sc]e bsd"),
    ("bsd", "redistributions", 30, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", 30, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("redistribution-notice", "redistribution", 5, "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    # Apache
    ("apache-1.0", "apache", 20, "(?:the )?apache (?:software )?license(?: version)? 1 0"),
    ("apache-1.1", "apache", 20, "(?:the )?apache (?:software )?license(?: version)? (?:v)?1 1"),
    ("apache-2.0", "apache", 40, "(?:licensed|distributed|released|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?license(?: version)? (?:2 0|v2 0|2|v2)"),
    ("apache-2.0", "apache", 20, "(?:the )?apache (?:software )?licen[sc]e(?: version)? (?:2 0|v2 0|2|v2)"),
    ("apache-2.0", "apache", 20, "apache (?:2 0|2|v2) licen[sc]e"),
    ("apache-2.0", "apache", 10, "(?:spdx license identifier|licen[sc]e) apache 2(?: 0)?"),
    ("apache-2.0", "compliance", 30, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "apache", 30, "http(?:s)? www apache org licenses license 2 0"),
    ("apache-2.0", "permissions", 30, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "apache", 40, "(?:licensed|distributed|released|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e"),
    ("apache", "apache", 30, "(?:subject to|governed by|covered by|according to) (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e"),
    ("apache", "apache", 20, "(?:the )?apache (?:software )?licen[sc]e"),
    ("apache-1.1", "apache", 30, "this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl-1.0", "general", 20, "(?:the )?(?:gnu )?general public license(?: version)? (?:1|v1)(?: 0)?"),
    ("gpl-2.0", "general", 20, "(?:the )?(?:gnu )?general public license(?: version)? (?:2|v2)(?: 0)?"),
    ("gpl-3.0", "general", 20, "(?:the )?(?:gnu )?general public license(?: version)? (?:3|v3)(?: 0)?"),
    ("gpl-2.0-or-later", "general", 40, "gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "general", 40, "gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0-only", "general", 40, "gnu general public license(?: version 2)? as published by the free software foundation version 2 of the license"),
    ("gpl-2.0-only", "general", 40, "gnu general public license version 2 only"),
    ("gpl-2.0", "gpl", 20, "(?:gnu )?gpl (?:version )?(?:2|v2)(?: 0)?(?: licen[sc]e)?"),
    ("gpl-3.0", "gpl", 20, "(?:gnu )?gpl (?:version )?(?:3|v3)(?: 0)?(?: licen[sc]e)?"),
    ("gpl-2.0", "gplv2", 20, "gplv2(?: licen[sc]e)?"),
    ("gpl-3.0", "gplv3", 20, "gplv3(?: licen[sc]e)?"),
    ("gpl-2.0-only", "gpl", 30, "gpl 2 0 only"),
    ("gpl-3.0-only", "gpl", 30, "gpl 3 0 only"),
    ("gpl-2.0-or-later", "gpl", 30, "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gpl", 30, "gpl 3 0 or later"),
    ("gpl", "gpl", 40, "(?:licensed|distributed|released|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl", "gpl", 20, "(?:the )?gnu gpl(?: licen[sc]e)?"),
    ("gpl", "gpl", 10, "(?:gpl licen[sc]e|licen[sc]e gpl)"),
    ("gpl", "general", 40, "(?:licensed|distributed|released|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e"),
    ("gpl", "general", 30, "(?:subject to|governed by|covered by|according to) (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e"),
    ("gpl", "general", 20, "(?:the )?(?:gnu )?general public licen[sc]e"),
    ("gpl", "redistribute", 30, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "everyone", 5, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-classpath-exception", "classpath", 20, "(?:the )?(?:gnu )?classpath exception"),
    ("gpl-font-exception", "font", 20, "gpl font exception"),
    ("gpl-gcc-exception", "gcc", 20, "gcc runtime library exception"),
    ("lgpl-2.0", "library", 20, "(?:the )?(?:gnu )?library general public license(?: version)?(?: 2| v2)?(?: 0)?"),
    ("lgpl-2.1", "lesser", 20, "(?:the )?(?:gnu )?lesser general public license(?: version)? (?:2 1|v2 1)"),
    ("lgpl-3.0", "lesser", 20, "(?:the )?(?:gnu )?lesser general public license(?: version)? (?:3|v3)(?: 0)?"),
    ("lgpl-2.1-or-later", "lesser", 40, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version"),
    ("lgpl-3.0-or-later", "lesser", 40, "gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("lgpl", "lesser", 20, "(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.1", "lgpl", 20, "(?:gnu )?lgpl (?:version )?(?:2 1|v2 1)(?: licen[sc]e)?"),
    ("lgpl-3.0", "lgpl", 20, "(?:gnu )?lgpl (?:version )?(?:3|v3)(?: 0)?(?: licen[sc]e)?"),
    ("lgpl-3.0", "lgplv3", 20, "lgplv3(?: licen[sc]e)?"),
    ("lgpl", "lgpl", 10, "(?:the )?(?:gnu )?lgpl(?: licen[sc]e)?"),
    ("agpl-3.0", "affero", 20, "(?:the )?(?:gnu )?affero general public license(?: version)?(?: 3| v3)?(?: 0)?"),
    ("agpl-3.0-or-later", "affero", 40, "gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("agpl-3.0", "agpl", 20, "(?:gnu )?agpl(?: version)?(?: 3| v3)?(?: 0)?(?: licen[sc]e)?"),
    ("agpl-3.0", "agplv3", 20, "agplv3(?: licen[sc]e)?"),
    ("gfdl", "documentation", 20, "(?:the )?(?:gnu )?free documentation license(?: version)?(?: 1 [123])?"),
    ("gfdl", "invariant", 30, "with no invariant sections no front cover texts and no back cover texts"),
    # Weak copyleft and vendors
    ("mpl-1.0", "mozilla", 20, "(?:the )?mozilla public license(?: version| v)? 1 0"),
    ("mpl-1.1", "mozilla", 20, "(?:the )?mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", 20, "(?:the )?mozilla public license(?: version| v)? 2 0"),
    ("mpl-2.0", "mozilla", 40, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", 20, "mpl (?:version )?(?:2 0|2|v2)(?: licen[sc]e)?"),
    ("mpl", "mozilla", 20, "(?:the )?mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", 20, "(?:the )?eclipse public license(?: version| v)? 1 0"),
    ("epl-2.0", "eclipse", 20, "(?:the )?eclipse public license(?: version| v)? 2 0"),
    ("epl", "eclipse", 20, "(?:the )?eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", 20, "(?:the )?eclipse distribution license(?: v 1 0)?"),
    ("cddl", "cddl", 10, "cddl(?: 1 [01])?(?: licen[sc]e)?"),
    ("cddl", "development", 20, "common development and distribution license(?: version)?(?: 1 [01])?"),
    ("cpl-1.0", "common", 20, "(?:the )?common public license(?: version| v)?(?: 1 0)?"),
    ("cpal-1.0", "attribution", 20, "common public attribution license(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm", 20, "(?:the )?ibm public license(?: version)?(?: 1 0)?"),
    ("eupl", "european", 20, "european union public licen[sc]e(?: version| v)?(?: 1 [0-2])?"),
    ("eupl", "eupl", 10, "eupl(?: v)?(?: 1 [0-2])?"),
    ("cecill", "cecill", 20, "cecill(?: b| c)?(?: free software)? license(?: agreement)?"),
    ("osl-3.0", "open", 20, "open software license(?: version| v)?(?: 3 0| 2 1)?"),
    ("qpl-1.0", "public", 20, "(?:the )?q public license(?: version)?(?: 1 0)?"),
    ("artistic-1.0", "artistic", 20, "(?:the )?(?:clarified )?artistic license(?: version)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", 20, "(?:the )?artistic license(?: version)? 2 0"),
    ("sissl", "industry", 20, "sun industry standards source license"),
    ("apsl-2.0", "apple", 20, "apple public source license(?: version)?(?: 2 0| 1 [0-2])?"),
    ("ms-pl", "microsoft", 20, "microsoft public license(?: ms pl)?"),
    ("ms-rl", "reciprocal", 20, "microsoft reciprocal license(?: ms rl)?"),
    ("nasa-1.3", "nasa", 20, "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("rpl-1.5", "reciprocal", 20, "reciprocal public license(?: version)?(?: 1 [15])?"),
    ("sleepycat", "sleepycat", 20, "(?:the )?sleepycat (?:software )?(?:product )?licen[sc]e"),
    # Source available
    ("sspl-1.0", "server", 20, "server side public license(?: version| v)?(?: 1)?"),
    ("sspl-1.0", "sspl", 10, "sspl(?: v1| 1 0)?"),
    ("busl-1.1", "business", 20, "business source license(?: version)?(?: 1 1)?"),
    ("elastic-2.0", "elastic", 20, "(?:the )?elastic license(?: version)?(?: 2 0| v2)?"),
    ("polyform-noncommercial", "polyform", 20, "polyform noncommercial license(?: 1 0 0)?"),
    ("commons-clause", "commons", 20, "commons clause(?: license condition)?"),
    ("confluent", "confluent", 20, "confluent community license(?: agreement)?"),
    ("openrail-m", "openrail", 20, "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    # Contents, data and fonts
    ("cc0-1.0", "cc0", 20, "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "waived", 30, "waived all copyright and related or neighboring rights"),
    ("cc-by-3.0", "attribution", 20, "creative commons attribution 3 0(?: unported)?(?: international)?(?: license)?"),
    ("cc-by-4.0", "attribution", 20, "creative commons attribution 4 0(?: international)?(?: public)?(?: license)?"),
    ("cc-by", "attribution", 10, "creative commons attribution(?: licen[sc]e)?"),
    ("cc-by-sa", "sharealike", 20, "creative commons attribution sharealike(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-sa", "alike", 20, "creative commons attribution share alike(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by-nd", "noderivatives", 20, "creative commons attribution noderivatives(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by-nc", "noncommercial", 20, "creative commons attribution noncommercial(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "noncommercial", 30, "creative commons attribution noncommercial sharealike(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "noncommercial", 30, "creative commons attribution noncommercial noderiv(?:ative)?s(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by", "cc", 20, "(?:licen[sc]e |licensed under )?cc by (?:[1-4] 0|licen[sc]e)"),
    ("cc-by-sa", "cc", 20, "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", 20, "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", 20, "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", 30, "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", 30, "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "creativecommons", 20, "creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", "creativecommons", 20, "creativecommons org licenses by sa [1-4] 0"),
    ("cc0-1.0", "creativecommons", 20, "creativecommons org publicdomain zero 1 0"),
    ("cc", "commons", 10, "(?:a |the )?creative commons licen[sc]e"),
    ("odbl-1.0", "database", 20, "(?:open data commons )?open database license(?: odbl)?(?: v1 0| 1 0)?"),
    ("odc-by-1.0", "commons", 20, "open data commons attribution license(?: v1 0)?"),
    ("pddl-1.0", "dedication", 20, "public domain dedication and licen[sc]e"),
    ("ogl-uk", "government", 20, "open government licen[sc]e(?: v(?:ersion)? ?[1-3](?: 0)?| v[1-3] 0)?"),
    ("ofl-1.1", "font", 20, "(?:sil )?open font license(?: version)?(?: 1 [01])?"),
    ("ofl-1.1", "ofl", 10, "(?:sil ofl|ofl)(?: 1 [01])"),
    ("bitstream-vera", "bitstream", 30, "the names bitstream or the word vera"),
    ("opl-1.0", "publication", 20, "open publication license(?: v1 0)?"),
    # Statements of rights
    ("public-domain", "domain", 20, "(?:released |placed |dedicated )?(?:in |into |to )?the public domain"),
    ("all-rights-reserved", "reserved", 20, "all rights reserved"),
    ("proprietary", "confidential", 20, "proprietary and confidential"),
    ("proprietary", "unauthorized", 20, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade", 10, "contains (?:confidential and proprietary|proprietary) information and trade secrets"),
    ("eula", "eula", 10, "(?:the |this )?eula"),
    ("eula", "end", 20, "end user licen[sc]e agreement"),
    ("freeware", "freeware", 10, "(?:is |as )?freeware"),
    ("shareware", "shareware", 10, "(?:is |as )?shareware"),
    ("permission-notice", "granted", 5, "permission is hereby granted free of charge"),
    ("warranty-disclaimer", "warranty", 5, "without (?:any )?warranty(?: of any kind)?"),
    ("warranty-disclaimer", "merchantability", 5, "warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("liability-disclaimer", "liable", 5, "in no event shall the (?:authors or copyright holders|copyright holders? or contributors|authors?) be liable for any"),
]
