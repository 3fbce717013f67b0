"""License signatures written by hand: names, notices, clauses and headers.

Each has its label, the keyword that stands in whatever it matches, its pattern over lower-case words, priority (0 is the highest) and
confidence. Priority 0 are identifiers and grants that name a license, 1 its text and full name, 2 short names, 3 hints.
"""

from __future__ import annotations

#: Label, keyword, pattern, priority, confidence.
WRITTEN = [
    # Permission notices and clauses of license texts.
    ("mit", "sell copies", r"use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software", 1, 0.95),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1, 0.9),
    ("mit", "as is", r"the software is provided as is without warranty of any kind express or implied", 2, 0.6),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement", 2, 0.5),
    ("mit", "expat", r"expat licen[cs]e", 1, 0.9),
    ("mit", "x11", r"(?:mit x11|x11 mit) licen[cs]e", 1, 0.9),
    ("x11", "x11", r"x11 licen[cs]e", 2, 0.7),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 1, 0.95),
    ("mit-modern", "modern variant", r"mit licen[cs]e modern variant", 1, 0.9),
    ("bsd-2-clause", "documentation and or other materials", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 2, 0.7),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.7),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 1, 0.95),
    ("bsd-3-clause", "endorse or promote", r"may not be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.7),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1, 0.95),
    ("bsd", "regents", r"copyright (?:c )?(?:[0-9]+ )*the regents of the university of california", 2, 0.6),
    ("bsd-1-clause", "bsd 1", r"bsd 1 clause", 1, 0.9),
    ("bsd-3-clause-clear", "clear", r"(?:clear bsd|bsd 3 clause clear) licen[cs]e", 1, 0.9),
    ("bsd-2-clause-patent", "patent", r"bsd (?:2 clause )?(?:plus )?patent licen[cs]e", 1, 0.9),
    ("bsd-3-clause-lbnl", "lbnl", r"bsd 3 clause lbnl", 1, 0.9),
    ("bsd-3-clause-lbnl", "lawrence berkeley", r"lawrence berkeley national labs bsd", 1, 0.9),
    ("bsd-source-code", "bsd source", r"bsd source code attribution", 1, 0.9),
    ("isc", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 1, 0.9),
    ("isc", "author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software", 1, 0.8),
    ("0bsd", "for any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1, 0.95),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 1, 0.95),
    ("zlib", "damages arising", r"in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.8),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", 1, 0.9),
    ("libpng", "png reference", r"png reference library licen[cs]e", 1, 0.9),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at https? www apache org licen[cs]es licen[cs]e 2 0", 0, 1.0),
    ("apache-2.0", "apache", r"www apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?", 1, 0.95),
    ("apache-2.0", "grant of patent", r"grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants", 1, 0.95),
    ("apache-2.0", "contributor licen", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", 0, 1.0),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 1, 0.85),
    ("apache-1.1", "apache", r"products derived from this software may not be called apache", 1, 0.9),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation", 0, 0.95),
    ("gpl-2.0-or-later", "version 2", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version", 0, 1.0),
    ("gpl-3.0-or-later", "version 3", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 0, 1.0),
    ("gpl-2.0-only", "version 2", r"gnu general public licen[cs]e version 2 as published by the free software foundation", 0, 1.0),
    ("gpl-3.0-only", "version 3", r"gnu general public licen[cs]e version 3 as published by the free software foundation", 0, 1.0),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 1, 0.8),
    ("gpl", "share and change", r"the gnu general public licen[cs]e is intended to guarantee your freedom to share and change", 1, 0.95),
    ("gpl", "absolutely no warranty", r"comes with absolutely no warranty for details type show w", 1, 0.9),
    ("gpl", "without even the implied", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", 1, 0.95),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program", 1, 0.95),
    ("gpl", "copyleft", r"www gnu org copyleft gpl(?: txt| html)?", 1, 0.9),
    ("gpl", "gnu org", r"www gnu org licen[cs]es gpl(?: [123] 0)?(?: txt| html)?", 1, 0.9),
    ("gpl", "gplv", r"gplv[123](?: or later)?", 1, 0.85),
    ("gpl-classpath-exception", "classpath", r"gpl(?: version)? ?2 with(?: the)? classpath exception|classpath exception", 1, 0.9),
    ("gpl-classpath-exception", "combined work", r"linking this library statically or dynamically with other modules is making a combined work", 1, 0.9),
    ("gpl-gcc-exception", "runtime library", r"gcc runtime library exception", 1, 0.9),
    ("gpl-font-exception", "font exception", r"(?:gpl )?font exception", 1, 0.8),
    ("gpl-bison-exception", "bison", r"bison (?:parser )?(?:special )?exception", 1, 0.85),
    ("gpl-linking-exception", "linking exception", r"(?:gpl )?(?:static )?linking exception", 1, 0.8),
    ("gpl-openssl-exception", "openssl", r"permission to link (?:the code of )?(?:[^ ]+ ){1,8}with the openssl library", 1, 0.9),
    ("gpl-autoconf-exception", "autoconf", r"autoconf (?:configure script )?exception", 1, 0.85),
    ("linux-syscall-note", "syscall", r"linux syscall note", 1, 0.9),
    ("llvm-exception", "llvm", r"(?:apache licen[cs]e )?(?:v2 0 )?with llvm exceptions?", 1, 0.95),
    ("lgpl", "lesser general public", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 0, 0.95),
    ("lgpl-2.1-or-later", "version 2 1", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version", 0, 1.0),
    ("lgpl-3.0-or-later", "version 3", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 0, 1.0),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:library|program)", 1, 0.95),
    ("lgpl", "library general public", r"gnu library general public licen[cs]e", 1, 0.9),
    ("lgpl", "gnu org", r"www gnu org licen[cs]es lgpl(?: [23] [01])?(?: txt| html)?", 1, 0.9),
    ("agpl", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 0, 0.95),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 0, 1.0),
    ("agpl", "remote network", r"remote network interaction use with the gnu general public licen[cs]e", 1, 0.95),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 0, 1.0),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 1, 0.9),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 0, 1.0),
    ("mpl-2.0", "mozilla org", r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0", 0, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 0, 1.0),
    ("mpl", "initial developer", r"the initial developer of the original code is", 2, 0.6),
    ("mpl-1.1-gpl-lgpl", "tri licen", r"mozilla tri licen[cs]e", 1, 0.95),
    ("mpl-1.1-gpl-lgpl", "mpl 1 1 gpl", r"mpl 1 1 gpl 2 0 lgpl 2 1", 1, 0.95),
    ("npl", "netscape", r"netscape public licen[cs]e(?: version 1 [01])?", 1, 0.9),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0", 0, 1.0),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v |version )?2 0", 0, 1.0),
    ("epl", "eclipse org", r"www eclipse org legal epl v[12]0(?: html)?", 1, 0.95),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution licen[cs]e(?: v 1 0)?", 1, 0.9),
    ("cpl-1.0", "common public", r"accompanying materials are made available under the terms of the common public licen[cs]e v1 0", 0, 1.0),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 0, 0.95),
    ("cddl", "opensolaris", r"you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e", 1, 0.9),
    ("artistic", "prominent notice", r"you may otherwise modify your copy of this package in any way provided that you insert a prominent notice", 1, 0.9),
    ("artistic-perl", "perl itself", r"this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself", 0, 0.95),
    ("artistic-perl", "perl", r"same terms as perl(?: 5)?(?: itself)?", 1, 0.85),
    ("clarified-artistic", "clarified", r"clarified artistic licen[cs]e", 1, 0.9),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0 see accompanying file", 0, 1.0),
    ("bsl-1.0", "machine executable", r"solely in the form of machine executable object code generated by a source language processor", 1, 0.95),
    ("bsl-1.0", "boost org", r"www boost org licen[cs]e 1 0 txt", 1, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 1.0),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 1, 0.95),
    ("unlicense", "unlicense org", r"https? unlicense org", 1, 0.9),
    ("wtfpl", "do what the", r"do what the (?:fuck|f) you want to(?: public licen[cs]e)?", 1, 0.95),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related (?:and|or) neighboring rights", 1, 0.95),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("cc0-1.0", "universal", r"creative commons (?:cc0 )?(?:zero )?(?:v ?)?1 0 universal", 1, 0.9),
    ("cc-pddc", "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?", 1, 0.85),
    ("cc-by", "creativecommons org", r"creativecommons org licen[cs]es by [1-4] [05]", 1, 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licen[cs]es by sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licen[cs]es by nc [1-4] [05]", 1, 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licen[cs]es by nd [1-4] [05]", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licen[cs]es by nc sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licen[cs]es by nc nd [1-4] [05]", 1, 0.95),
    ("ofl-1.1", "sil open font", r"this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1", 0, 1.0),
    ("ofl", "reserved font name", r"with reserved font name", 1, 0.85),
    ("ofl", "scripts sil", r"scripts sil org ofl", 1, 0.9),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("bitstream-vera", "bitstream", r"bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)", 1, 0.9),
    ("lppl", "latex project", r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 0, 0.95),
    ("psf-2.0", "python software foundation", r"python software foundation licen[cs]e version 2", 0, 1.0),
    ("psf", "psf is making", r"psf is making python available to licensee on an as is basis", 1, 0.95),
    ("cnri-python", "cnri", r"cnri (?:open source )?(?:gpl compatible )?(?:python )?licen[cs]e agreement", 1, 0.9),
    ("beopen-python", "beopen", r"beopen python(?: open source)? licen[cs]e agreement", 1, 0.9),
    ("ruby", "ruby", r"(?:distributed|released|licen[cs]ed) under the (?:same )?terms (?:of|as) ruby|ruby s? ?licen[cs]e", 1, 0.85),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php licen[cs]e", 0, 1.0),
    ("php", "php", r"this product includes php software freely available from", 1, 0.9),
    ("zend-2.0", "zend", r"zend (?:engine )?licen[cs]e(?: version 2 0+)?", 1, 0.9),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", 1, 0.9),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1, 0.95),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 1, 0.95),
    ("curl", "curl", r"curl licen[cs]e", 1, 0.85),
    ("icu", "icu", r"icu licen[cs]e(?: icu 1 8 1 and later)?", 1, 0.85),
    ("unicode", "unicode", r"unicode(?: inc)? licen[cs]e agreement data files and software", 1, 0.95),
    ("unicode", "unicode", r"unicode terms of use", 2, 0.7),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group", 1, 0.95),
    ("ftl", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 1, 0.9),
    ("ftl", "freetype", r"portions of this software are copyright (?:[^ ]+ ){1,6}the freetype project", 1, 0.95),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 1, 0.9),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", 1, 0.85),
    ("vim", "vim", r"vim licen[cs]e", 1, 0.85),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? licen[cs]e", 1, 0.9),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", 1, 0.9),
    ("sqlite-blessing", "may you do good", r"may you do good and not evil may you find forgiveness for yourself and forgive others", 1, 0.95),
    ("json", "good not evil", r"the software shall be used for good not evil", 1, 0.95),
    ("ntp", "ntp", r"ntp licen[cs]e", 1, 0.8),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 1, 0.9),
    ("naist", "naist", r"naist(?: 2003)? licen[cs]e", 1, 0.85),
    ("afl", "academic free", r"licen[cs]ed under the academic free licen[cs]e", 0, 0.95),
    ("apsl", "apple public", r"apple public source licen[cs]e(?: version [12] [0-9])?", 1, 0.9),
    ("apsl", "apsl", r"apsl [12] [0-9]", 1, 0.9),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e(?: 1 [15])?", 1, 0.9),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("sleepycat", "sleepycat", r"sleepycat(?: software)? licen[cs]e", 1, 0.9),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e", 1, 0.9),
    ("spl-1.0", "sun public", r"sun public licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("scsl", "sun community", r"sun community source licen[cs]e", 1, 0.9),
    ("bcl", "binary code", r"(?:sun|oracle) binary code licen[cs]e agreement", 1, 0.95),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: v ?1 0)?", 1, 0.9),
    ("nasa-1.3", "nasa open", r"nasa open source agreement(?: version 1 3)?", 1, 0.9),
    ("watcom-1.0", "watcom", r"sybase open watcom public licen[cs]e", 1, 0.9),
    ("motosoto", "motosoto", r"motosoto licen[cs]e", 1, 0.85),
    ("nokia", "nokia open", r"nokia open source licen[cs]e", 1, 0.9),
    ("intel", "intel open", r"intel open source licen[cs]e", 1, 0.9),
    ("realnetworks", "realnetworks", r"realnetworks public source licen[cs]e", 1, 0.9),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: version [12] 0)?", 1, 0.9),
    ("ecos-2.0", "ecos", r"ecos licen[cs]e(?: version 2 0)?", 1, 0.85),
    ("entessa", "entessa", r"entessa public licen[cs]e", 1, 0.9),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained with the works", 1, 0.95),
    ("miros", "miros", r"miros licen[cs]e", 1, 0.85),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software licen[cs]e(?: v(?:ersion)? ?[12])?", 1, 0.9),
    ("mulanpsl-2.0", "mulan", r"mulan ?psl ?v?[12]", 1, 0.9),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", 1, 0.9),
    ("cecill", "cecill", r"(?:ce logiciel est )?(?:regi|governed) (?:par|by) (?:la licence|the) cecill(?: [bc])?(?: license)?", 0, 0.95),
    ("eupl", "eupl", r"licen[cs]ed under the eupl", 0, 0.95),
    ("etalab-2.0", "ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", 1, 0.9),
    ("etalab-2.0", "etalab", r"etalab 2 0", 1, 0.9),
    ("ogl-uk", "open government", r"open government licen[cs]e(?: v ?[123](?: 0)?)?", 1, 0.9),
    ("cdla-permissive", "community data", r"community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?", 1, 0.9),
    ("cdla-sharing", "community data", r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?", 1, 0.9),
    ("odbl-1.0", "open database", r"this database is made available under the open database licen[cs]e", 0, 1.0),
    ("dbcl-1.0", "database contents", r"database contents licen[cs]e", 1, 0.9),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: ?\+?\+? ?m)?(?: licen[cs]e)?", 1, 0.85),
    ("openrail", "responsible ai", r"responsible ai licen[cs]e", 1, 0.85),
    ("llama", "llama", r"llama ?[234]?(?: 1| 2)? community licen[cs]e(?: agreement)?", 1, 0.9),
    ("gemma", "gemma", r"gemma terms of use", 1, 0.85),
    ("bigscience-rail", "bigscience", r"bigscience (?:open ?)?rail(?: m)? licen[cs]e", 1, 0.9),
    # Source available and commercial terms.
    ("busl-1.1", "business source", r"business source licen[cs]e(?: 1 1)?", 1, 0.9),
    ("busl-1.1", "change date", r"change date (?:[^ ]+ ){1,8}change licen[cs]e", 1, 0.85),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: v(?:ersion)? ?1)?", 1, 0.9),
    ("sspl-1.0", "sspl", r"sspl(?: v?1)?", 2, 0.8),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: v?2(?: 0)?)?", 1, 0.9),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?", 1, 0.9),
    ("confluent-1.0", "confluent", r"confluent community licen[cs]e", 1, 0.9),
    ("polyform-noncommercial", "polyform", r"polyform non ?commercial licen[cs]e(?: 1 0 0)?", 1, 0.9),
    ("polyform-small-business", "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?", 1, 0.9),
    ("polyform-shield", "polyform", r"polyform (?:perimeter|shield|strict|free trial) licen[cs]e", 1, 0.9),
    ("fsl-1.1", "functional source", r"functional source licen[cs]e(?: version 1 1)?", 1, 0.9),
    ("parity", "parity public", r"parity public licen[cs]e", 1, 0.9),
    ("prosperity", "prosperity public", r"prosperity public licen[cs]e", 1, 0.9),
    ("timescale", "timescale", r"timescale licen[cs]e agreement", 1, 0.9),
    ("redis-source-available", "redis source", r"redis source available licen[cs]e(?: agreement)?", 1, 0.9),
    ("mongodb", "mongodb", r"mongodb (?:community|enterprise) licen[cs]e", 1, 0.85),
    ("oracle-otn", "oracle technology", r"oracle technology network (?:developer )?licen[cs]e(?: agreement)?", 1, 0.9),
    ("microsoft-eula", "microsoft software", r"microsoft software licen[cs]e terms", 1, 0.9),
    ("nvidia", "nvidia", r"nvidia (?:software|source code|cuda toolkit end user) licen[cs]e(?: agreement)?", 1, 0.85),
    ("adobe", "adobe", r"adobe systems incorporated open source licen[cs]e agreement|adobe (?:glyph list )?licen[cs]e", 1, 0.85),
    ("unrar", "unrar", r"unrar (?:source )?(?:licen[cs]e|restriction)", 1, 0.85),
    ("proprietary", "end user", r"end user licen[cs]e agreement", 2, 0.6),
    ("proprietary", "eula", r"eula", 3, 0.4),
    ("proprietary", "confidential", r"(?:strictly |company |proprietary and )confidential (?:and proprietary|information|do not distribute)", 2, 0.6),
    ("proprietary", "may not be", r"may not be (?:copied|reproduced|distributed)(?: [^ ]+){0,12} without the (?:express |prior )+written (?:consent|permission)", 2, 0.6),
    ("proprietary", "trade secret", r"(?:contains|constitutes) (?:[^ ]+ ){0,6}trade secrets?", 2, 0.5),
    ("non-commercial", "commercial use", r"(?:for )?non ?commercial use only|not for commercial use", 2, 0.6),
    ("non-commercial", "purposes only", r"(?:for )?(?:academic|research|educational)(?: and (?:academic|research|educational))? purposes only", 2, 0.6),
    ("evaluation", "evaluation", r"(?:for )?evaluation (?:purposes|use) only", 2, 0.6),
    ("freeware", "freeware", r"freeware(?: licen[cs]e)?", 3, 0.4),
    ("shareware", "shareware", r"shareware(?: licen[cs]e)?", 3, 0.4),
    ("donationware", "donationware", r"donationware", 3, 0.4),
    ("postcardware", "cardware", r"(?:post)?cardware", 3, 0.4),
    ("public-domain", "copyright", r"no (?:known )?copyright(?: restrictions)?(?: is claimed)?", 2, 0.5),
    ("public-domain", "united states government", r"work of the united states government(?: and)?(?: is)? not subject to copyright protection", 1, 0.9),
    ("copyright", "copyright", r"copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?", 3, 0.2),
    ("no-license", "not licen", r"(?:is )?not licen[cs]ed for (?:use|redistribution|distribution)", 2, 0.5),
    ("see-license-file", "file", r"see (?:the )?(?:accompanying |included )?licen[cs]e(?: txt| md)? file", 3, 0.3),
    ("see-license-file", "copying", r"see (?:the )?(?:file )?copying(?: txt)?(?: file)?(?: for details)?", 3, 0.3),
    ("dual", "dual licen", r"dual licen[cs]ed(?: under)?", 3, 0.3),
]
