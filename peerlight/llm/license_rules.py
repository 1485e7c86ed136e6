"""Signature rules of licences, in order: label, priority, keyword and a hand-written regex.

Rules read a text as its words (A-Z lowered, cut at everything that is neither a digit, a letter
nor beyond ASCII) joined by blanks, so that line breaks, comment marks and punctuation do not
matter: "GPL-2.0+" is "gpl 2 0", a link is "http www apache org licenses license 2 0". A regex
matches whole words. It is tried only in texts that hold its keyword, which every match of it
contains. Priorities: 5 tags, 4 texts and links, 3 names with versions, 2 names, 1 hints.
"""

from __future__ import annotations

from dataclasses import dataclass

TAG, TEXT, VERSION, NAME, HINT = 5, 4, 3, 2, 1


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    regex: str


#: Base phrases: their places are counted and their labels always stay.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Labels whose words, as they stand after "spdx license identifier", are a tag of their own.
TAGGED = """
0bsd aal afl-2.1 afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0
apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause
bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c
cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap
ftl gfdl-1.2-only gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-2.0-only gpl-2.0-or-later
gpl-3.0-only gpl-3.0-or-later hpnd icu ijg imagemagick ipl-1.0 isc json lgpl-2.0-only
lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later libpng liliq-p-1.1 lppl-1.3c
mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa ntp odbl-1.0 odc-by-1.0 ofl-1.1
openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sissl sspl-1.0
sleepycat tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1
""".split()

# Fixed pieces of the regexes below.
_V2, _V3 = "(?:v ?|version )?2(?: 0)?", "(?:v ?|version )?3(?: 0)?"
_LATER = "(?: or| and)?(?: at your option)?(?: any)? later(?: version)?"
_CC = "creative commons attribution"

HAND_WRITTEN = [
    # MIT and its kin
    ("mit", TEXT, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", TEXT, "deal in the software without restriction", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", TEXT, "this permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", TEXT, "opensource org", r"(?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", VERSION, "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: licen[cs]e)?"),
    ("mit", NAME, "mit", r"(?:the )?mit(?: expat)?(?: style)? licen[cs]e(?: mit)?"),
    ("mit", NAME, "license mit", r"license mit"),
    ("mit", NAME, "mit licensed", r"mit licensed"),
    ("mit", NAME, "expat", r"expat (?:mit )?licen[cs]e"),
    ("mit-0", TEXT, "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", VERSION, "mit 0", r"mit 0(?: licen[cs]e)?"),
    ("x11", NAME, "x11", r"(?:mit )?x11(?: style)? licen[cs]e"),
    ("x11", TEXT, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("hpnd", TEXT, "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("isc", TEXT, "permission to use copy modify and or distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice)?"),
    ("isc", NAME, "isc", r"(?:the )?isc licen[cs]e"),
    ("isc", TEXT, "opensource org", r"(?:https? )?(?:www )?opensource org licenses? isc(?: license)?"),
    ("0bsd", NAME, "zero clause bsd", r"zero clause bsd(?: licen[cs]e)?"),
    ("0bsd", VERSION, "0bsd", r"0bsd"),
    ("ntp", NAME, "ntp license", r"(?:the )?ntp license"),
    ("curl", NAME, "curl license", r"(?:the )?curl license"),
    ("tcl", NAME, "tcl tk", r"tcl tk licen[cs]e(?: terms)?"),
    ("postgresql", NAME, "postgresql", r"(?:the )?postgresql licen[cs]e"),
    ("postgresql", TEXT, "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", NAME, "ncsa", r"(?:university of illinois )?(?:uiuc )?ncsa(?: open source)? licen[cs]e"),
    ("ncsa", NAME, "university of illinois", r"university of illinois (?:ncsa )?open source licen[cs]e"),
    ("unicode-dfs-2016", NAME, "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    ("icu", NAME, "icu license", r"icu license(?: icu \d+ \d+ \d+ and later)?"),
    ("json", TEXT, "good not evil", r"the software shall be used for good not evil"),
    ("json", NAME, "json license", r"(?:the )?json license"),
    # BSD
    ("bsd-2-clause", VERSION, "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", VERSION, "bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", TEXT, "opensource org", r"(?:https? )?(?:www )?opensource org licenses? bsd 2 clause"),
    ("bsd-2-clause-patent", VERSION, "patent", r"bsd (?:2|two) clause (?:plus )?patent(?: licen[cs]e)?"),
    ("bsd-3-clause", VERSION, "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: style)?(?: licen[cs]e)?"),
    ("bsd-3-clause", VERSION, "bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", TEXT, "opensource org", r"(?:https? )?(?:www )?opensource org licenses? bsd (?:3 clause|license)(?: php)?"),
    ("bsd-3-clause", TEXT, "endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", TEXT, "bsd style license that can be found", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-3-clause-clear", VERSION, "clear bsd", r"clear bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", VERSION, "bsd", r"(?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", TEXT, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", TEXT, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", TEXT, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", NAME, "bsd", r"(?:the )?bsd(?: style| type| like)? licen[cs]e"),
    ("bsd", NAME, "bsd licensed", r"bsd licensed"),
    ("bsd", HINT, "license bsd", r"license bsd"),
    # Apache
    ("apache-2.0", TEXT, "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", TEXT, "apache license", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", TEXT, "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", TEXT, "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", TEXT, "opensource org", r"(?:https? )?(?:www )?opensource org licenses? apache 2 0"),
    ("apache-2.0", VERSION, "apache", r"apache(?: software)?(?: public)? licen[cs]e(?: asl)? " + _V2),
    ("apache-2.0", VERSION, "apache", r"apache " + _V2 + r"(?: licen[cs]e)?"),
    ("apache-2.0", VERSION, "asl 2 0", r"asl 2 0"),
    ("apache-1.1", VERSION, "apache", r"apache(?: software)? licen[cs]e (?:version )?1 1"),
    ("apache-1.0", VERSION, "apache", r"apache(?: software)? licen[cs]e (?:version )?1 0"),
    ("apache", NAME, "apache", r"(?:the )?apache(?: software| public)? licen[cs]e"),
    ("apache", NAME, "apache licensed", r"apache licensed"),
    # GNU
    ("gpl-1.0-only", VERSION, "general public license", r"(?:gnu )?general public license (?:version |v)1"),
    ("gpl-2.0-only", VERSION, "general public license", r"(?:gnu )?general public license(?: gpl)? (?:as published by the free software foundation )?" + _V2 + r"(?: only)?"),
    ("gpl-2.0-only", TEXT, "general public license version 2", r"under the terms of the gnu general public license version 2 (?:only|as published by the free software foundation)"),
    ("gpl-2.0-only", VERSION, "gpl", r"(?:gnu )?gpl " + _V2 + r"(?: only)?"),
    ("gpl-2.0-only", VERSION, "gplv2", r"(?:gnu )?gplv2(?: only| 0)?"),
    ("gpl-2.0-or-later", VERSION, "general public license", r"(?:gnu )?general public license(?: gpl)? " + _V2 + _LATER),
    ("gpl-2.0-or-later", TEXT, "either version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0-or-later", VERSION, "gpl", r"(?:gnu )?gpl " + _V2 + r"(?: or)? later"),
    ("gpl-2.0-or-later", VERSION, "gplv2", r"(?:gnu )?gplv2 (?:or )?later"),
    ("gpl-3.0-only", VERSION, "general public license", r"(?:gnu )?general public license(?: gpl)? " + _V3 + r"(?: only)?"),
    ("gpl-3.0-only", VERSION, "gpl", r"(?:gnu )?gpl " + _V3 + r"(?: only)?"),
    ("gpl-3.0-only", VERSION, "gplv3", r"(?:gnu )?gplv3(?: only| 0)?"),
    ("gpl-3.0-or-later", VERSION, "general public license", r"(?:gnu )?general public license(?: gpl)? " + _V3 + _LATER),
    ("gpl-3.0-or-later", TEXT, "either version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0-or-later", VERSION, "gplv3", r"(?:gnu )?gplv3 (?:or )?later"),
    ("gpl", TEXT, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?"),
    ("gpl", TEXT, "gnu org copyleft", r"(?:https? )?(?:www )?gnu org copyleft gpl(?: html)?"),
    ("gpl", TEXT, "gnu general public license along with", r"you should have received a copy of the gnu general public license along with this (?:program|library|software|file)"),
    ("gpl", TEXT, "free software you can redistribute it", r"(?:this (?:program|file|software) is )?free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", NAME, "general public license", r"(?:gnu )?general public license"),
    ("gpl", NAME, "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl", NAME, "gnu gpl", r"gnu gpl"),
    ("gpl", HINT, "gpl", r"gpl licen[cs]e[ds]?"),
    ("lgpl-2.0-only", VERSION, "library general public license", r"(?:gnu )?library general public license(?: lgpl)?(?: (?:version |v)?2(?: 0)?)?"),
    ("lgpl-2.1-only", VERSION, "lesser general public license", r"(?:gnu )?lesser general public license(?: lgpl)? (?:version |v)?2 1(?: only)?"),
    ("lgpl-2.1-only", VERSION, "lgpl", r"(?:gnu )?lgpl (?:v |version )?2 1(?: only)?"),
    ("lgpl-2.1-only", VERSION, "lgplv2", r"(?:gnu )?lgplv2 1"),
    ("lgpl-2.1-or-later", VERSION, "lesser general public license", r"(?:gnu )?lesser general public license(?: lgpl)? (?:version |v)?2 1" + _LATER),
    ("lgpl-2.1-or-later", TEXT, "either version 2 1 of the license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", VERSION, "lgpl", r"(?:gnu )?lgpl (?:v |version )?2 1 (?:or )?later"),
    ("lgpl-3.0-only", VERSION, "lesser general public license", r"(?:gnu )?lesser general public license(?: lgpl)? " + _V3 + r"(?: only)?"),
    ("lgpl-3.0-only", VERSION, "lgpl", r"(?:gnu )?lgpl " + _V3),
    ("lgpl-3.0-only", VERSION, "lgplv3", r"(?:gnu )?lgplv3"),
    ("lgpl-3.0-or-later", VERSION, "lesser general public license", r"(?:gnu )?lesser general public license(?: lgpl)? " + _V3 + _LATER),
    ("lgpl", TEXT, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("lgpl", NAME, "lesser general public license", r"(?:gnu )?lesser general public license"),
    ("lgpl", NAME, "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e[ds]?)?"),
    ("agpl-3.0-only", VERSION, "affero general public license", r"(?:gnu )?affero general public license(?: agpl)? " + _V3 + r"(?: only)?"),
    ("agpl-3.0-only", VERSION, "agpl", r"(?:gnu )?agpl " + _V3),
    ("agpl-3.0-only", VERSION, "agplv3", r"(?:gnu )?agplv3"),
    ("agpl-3.0-or-later", VERSION, "affero general public license", r"(?:gnu )?affero general public license(?: agpl)? " + _V3 + _LATER),
    ("agpl-3.0-or-later", TEXT, "affero general public license as published", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", TEXT, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl", NAME, "affero general public license", r"(?:gnu )?affero general public license"),
    ("agpl", NAME, "agpl", r"(?:gnu )?agpl(?: licen[cs]e[ds]?)?"),
    ("gfdl-1.2-only", VERSION, "free documentation license", r"(?:gnu )?free documentation license (?:version |v)?1 2"),
    ("gfdl-1.3-only", VERSION, "free documentation license", r"(?:gnu )?free documentation license (?:version |v)?1 3"),
    ("gfdl-1.3-or-later", VERSION, "free documentation license", r"(?:gnu )?free documentation license (?:version |v)?1 3" + _LATER),
    ("gfdl", TEXT, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses fdl(?: 1 [23])?(?: html| txt)?"),
    ("gfdl", NAME, "free documentation license", r"(?:gnu )?free documentation license"),
    ("gfdl", NAME, "gfdl", r"(?:gnu )?gfdl"),
    ("fsfap", TEXT, "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # Creative Commons
    ("cc-by-1.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by 1 0"),
    ("cc-by-2.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by 2 0"),
    ("cc-by-2.5", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by 2 5"),
    ("cc-by-3.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by 3 0"),
    ("cc-by-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-3.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-3.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", TEXT, "creativecommons org licenses", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", TEXT, "creativecommons org publicdomain", r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
    ("cc-by-2.0", VERSION, "cc by 2 0", r"cc by 2 0(?: licen[cs]e)?"),
    ("cc-by-2.5", VERSION, "cc by 2 5", r"cc by 2 5(?: licen[cs]e)?"),
    ("cc-by-3.0", VERSION, "cc by 3 0", r"cc by 3 0(?: licen[cs]e)?"),
    ("cc-by-4.0", VERSION, "cc by 4 0", r"cc by 4 0(?: licen[cs]e)?"),
    ("cc-by-sa-2.0", VERSION, "cc by sa 2 0", r"cc by sa 2 0"),
    ("cc-by-sa-3.0", VERSION, "cc by sa 3 0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", VERSION, "cc by sa 4 0", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", VERSION, "cc by nc 4 0", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", VERSION, "cc by nd 4 0", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", VERSION, "cc by nc sa 4 0", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", VERSION, "cc by nc nd 4 0", r"cc by nc nd 4 0"),
    ("cc-by-3.0", VERSION, _CC, _CC + r" 3 0(?: unported| international)?(?: licen[cs]e)?"),
    ("cc-by-4.0", VERSION, _CC, _CC + r" 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-3.0", VERSION, _CC, _CC + r" share ?alike 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", VERSION, _CC, _CC + r" share ?alike 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-4.0", VERSION, _CC, _CC + r" non ?commercial 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd-4.0", VERSION, _CC, _CC + r" no ?deriv(?:ative)?s? 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", VERSION, _CC, _CC + r" non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", VERSION, _CC, _CC + r" non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa", NAME, _CC, _CC + r" share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc", NAME, _CC, _CC + r" non ?commercial(?: licen[cs]e)?"),
    ("cc-by-nd", NAME, _CC, _CC + r" no ?deriv(?:ative)?s?(?: licen[cs]e)?"),
    ("cc-by", NAME, _CC, _CC + r"(?: licen[cs]e)?"),
    ("cc-by-sa", NAME, "cc by sa", r"cc by sa"),
    ("cc-by-nc", NAME, "cc by nc", r"cc by nc"),
    ("cc-by-nd", NAME, "cc by nd", r"cc by nd"),
    ("cc-by-nc-sa", NAME, "cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", NAME, "cc by nc nd", r"cc by nc nd"),
    ("cc0-1.0", VERSION, "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", NAME, "creative commons zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("public-domain", NAME, "public domain", r"(?:released|placed|dedicated|put)(?: in| in to| into| to)? the public domain"),
    ("public-domain", NAME, "public domain", r"this (?:work|software|code|file) is in the public domain"),
    # Mozilla, Eclipse, Sun, IBM and others with weak copyleft
    ("mpl-1.0", VERSION, "mozilla public license", r"mozilla public license (?:version |v ?)?1 0"),
    ("mpl-1.1", VERSION, "mozilla public license", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", VERSION, "mozilla public license", r"mozilla public license(?: mpl)? " + _V2),
    ("mpl-2.0", TEXT, "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", TEXT, "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", VERSION, "mpl 1 1", r"mpl 1 1"),
    ("mpl-2.0", VERSION, "mpl 2 0", r"mpl 2 0"),
    ("mpl", NAME, "mozilla public license", r"mozilla public license"),
    ("mpl", HINT, "mpl", r"mpl licen[cs]e[ds]?"),
    ("epl-1.0", VERSION, "eclipse public license", r"eclipse public license(?: epl)? (?:version |v ?)?1 0"),
    ("epl-2.0", VERSION, "eclipse public license", r"eclipse public license(?: epl)? " + _V2),
    ("epl-2.0", TEXT, "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("epl-1.0", TEXT, "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl", NAME, "eclipse public license", r"eclipse public license"),
    ("edl-1.0", VERSION, "eclipse distribution license", r"eclipse distribution license(?: (?:version |v ?)?1 0)?"),
    ("cddl-1.0", VERSION, "common development and distribution license", r"common development and distribution license(?: cddl)? (?:version |v ?)?1 0"),
    ("cddl-1.1", VERSION, "common development and distribution license", r"common development and distribution license(?: cddl)? (?:version |v ?)?1 1"),
    ("cddl", NAME, "common development and distribution license", r"common development and distribution license"),
    ("cddl", HINT, "cddl", r"cddl(?: licen[cs]e[ds]?)?"),
    ("cpl-1.0", VERSION, "common public license", r"common public license(?: (?:version |v ?)?1 0)?"),
    ("ipl-1.0", VERSION, "ibm public license", r"ibm public license(?: (?:version |v ?)?1 0)?"),
    ("cpal-1.0", VERSION, "common public attribution license", r"common public attribution license(?: (?:version |v ?)?1 0)?"),
    ("eupl-1.1", VERSION, "european union public licence", r"european union public licence (?:version |v ?)?1 1"),
    ("eupl-1.2", VERSION, "european union public licence", r"european union public licence (?:version |v ?)?1 2"),
    ("eupl", NAME, "european union public licence", r"european union public licence"),
    ("eupl", HINT, "eupl", r"eupl"),
    ("cecill-2.1", VERSION, "cecill", r"cecill (?:version |v ?)?2 1"),
    ("cecill-b", VERSION, "cecill b", r"cecill b"),
    ("cecill-c", VERSION, "cecill c", r"cecill c"),
    ("cecill", NAME, "cecill", r"cecill(?: free software)?(?: licen[cs]e)?"),
    ("osl-3.0", VERSION, "open software license", r"open software license (?:version |v ?)?3 0"),
    ("osl", NAME, "open software license", r"open software license"),
    ("afl-3.0", VERSION, "academic free license", r"academic free license (?:version |v ?)?3 0"),
    ("afl-2.1", VERSION, "academic free license", r"academic free license (?:version |v ?)?2 1"),
    ("afl", NAME, "academic free license", r"academic free license"),
    ("ecl-2.0", VERSION, "educational community license", r"educational community license(?: (?:version |v ?)?2 0)?"),
    ("apsl-2.0", VERSION, "apple public source license", r"apple public source license(?: (?:version |v ?)?2 0)?"),
    ("sissl", NAME, "sun industry standards source license", r"sun industry standards source license"),
    ("qpl-1.0", VERSION, "q public license", r"q public license(?: (?:version |v ?)?1 0)?"),
    ("sleepycat", NAME, "sleepycat", r"sleepycat licen[cs]e"),
    ("lppl-1.3c", VERSION, "latex project public license", r"latex project public license(?: (?:version |v ?)?1 3c?)?"),
    ("ms-pl", NAME, "microsoft public license", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", NAME, "microsoft reciprocal license", r"microsoft reciprocal license(?: ms rl)?"),
    ("odbl-1.0", NAME, "open database license", r"open (?:data commons open )?database license(?: odbl)?(?: v?1 0)?"),
    ("odc-by-1.0", NAME, "open data commons attribution license", r"open data commons attribution license(?: odc by)?(?: v?1 0)?"),
    ("pddl-1.0", NAME, "public domain dedication and license", r"(?:open data commons )?public domain dedication and license(?: pddl)?"),
    # Languages, libraries and fonts
    ("artistic-1.0", VERSION, "artistic license", r"artistic license (?:version |v ?)?1 0"),
    ("artistic-2.0", VERSION, "artistic license", r"artistic license " + _V2),
    ("artistic", NAME, "artistic license", r"(?:the )?(?:perl )?artistic license"),
    ("artistic", TEXT, "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("psf-2.0", NAME, "python software foundation license", r"python software foundation license(?: (?:version |v ?)?2)?"),
    ("python-2.0", NAME, "python license", r"python license(?: 2 0)?"),
    ("php-3.01", VERSION, "php license", r"(?:the )?php license(?: (?:version |v ?)?3 01)?"),
    ("ruby", NAME, "ruby license", r"(?:the )?ruby license"),
    ("ruby", NAME, "ruby s license", r"ruby s license"),
    ("openssl", NAME, "openssl license", r"(?:the )?(?:dual )?openssl license"),
    ("openssl", TEXT, "openssl project for use", r"developed by the openssl project for use in the openssl toolkit"),
    ("vim", NAME, "vim license", r"(?:the )?vim license"),
    ("w3c", NAME, "w3c", r"w3c software(?: notice and)?(?: and document)? licen[cs]e"),
    ("zlib", NAME, "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("zlib", TEXT, "provided as is without any express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", TEXT, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("libpng", NAME, "libpng license", r"(?:the )?libpng license"),
    ("ijg", TEXT, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("imagemagick", NAME, "imagemagick license", r"(?:the )?imagemagick license"),
    ("bzip2-1.0.6", NAME, "bzip2", r"bzip2(?: and libbzip2)? licen[cs]e"),
    ("zpl-2.1", VERSION, "zope public license", r"zope public license(?: zpl)?(?: (?:version |v ?)?2 1)?"),
    ("bsl-1.0", NAME, "boost software license", r"boost software license(?: (?:version |v ?)?1 0)?"),
    ("bsl-1.0", TEXT, "boost org license", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("ofl-1.1", NAME, "open font license", r"(?:sil )?open font license(?: ofl)?(?: (?:version |v ?)?1 1)?"),
    ("ofl-1.1", TEXT, "scripts sil org ofl", r"(?:https? )?scripts sil org ofl"),
    ("ftl", NAME, "freetype", r"freetype (?:project )?licen[cs]e"),
    ("efl-2.0", NAME, "eiffel forum license", r"eiffel forum license(?: (?:version |v ?)?2)?"),
    ("upl-1.0", NAME, "universal permissive license", r"universal permissive license(?: upl)?(?: (?:version |v ?)?1 0)?"),
    ("blueoak-1.0.0", NAME, "blue oak model license", r"blue oak model license(?: 1 0 0)?"),
    ("mulanpsl-2.0", NAME, "mulan permissive software license", r"mulan permissive software license(?: v2)?"),
    ("unlicense", NAME, "unlicense", r"(?:the )?unlicense"),
    ("unlicense", TEXT, "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", TEXT, "unlicense org", r"(?:https? )?(?:www )?unlicense org"),
    ("wtfpl", NAME, "wtfpl", r"(?:the )?wtfpl(?: licen[cs]e)?"),
    ("wtfpl", NAME, "what the fuck you want to public license", r"do what the fuck you want to public license"),
    ("beerware", NAME, "beer ware", r"(?:the )?beer ware license(?: revision 42)?"),
    ("beerware", TEXT, "buy me a beer in return", r"you can buy me a beer in return"),
    # Source available and model licences
    ("sspl-1.0", NAME, "server side public license", r"server side public license(?: sspl)?(?: (?:version |v ?)?1)?"),
    ("busl-1.1", NAME, "business source license", r"business source license(?: (?:version |v ?)?1 1)?"),
    ("elastic-2.0", NAME, "elastic license", r"elastic license(?: (?:version |v ?)?2(?: 0)?)?"),
    ("commons-clause", NAME, "commons clause", r"commons clause(?: license condition)?(?: v?1 0)?"),
    ("polyform-noncommercial", NAME, "polyform noncommercial", r"polyform noncommercial license(?: 1 0 0)?"),
    ("openrail-m", NAME, "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),
    ("bigscience-rail-1.0", NAME, "rail license", r"(?:bigscience )?rail license(?: v?1 0)?"),
    ("llama-community", NAME, "community license agreement", r"llama [^ ]+ (?:[^ ]+ )?community license agreement"),
    # Terms that are no open licence, and hints
    ("proprietary", NAME, "all rights reserved", r"(?:copyright (?:[^ ]+ ){1,8})?all rights reserved"),
    ("proprietary", NAME, "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", NAME, "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", NAME, "end user license agreement", r"end user license agreement"),
    ("non-commercial", NAME, "non commercial", r"for (?:academic |personal |educational )?(?:and )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", NAME, "noncommercial", r"for noncommercial (?:use|purposes)(?: only)?"),
    ("unknown-license", HINT, "licensed under", r"licensed under (?:the )?(?:terms of (?:the )?)?(?:[^ ]+ ){1,4}licen[cs]e(?: (?:version |v ?)?[0-9]+(?: [0-9]+)?)?(?: or later)?"),
    ("unknown-license", HINT, "see the license", r"see the license (?:file )?for (?:the specific language|details|more information)"),
    ("unknown-license", HINT, "see the licence", r"see the licence (?:file )?for (?:the specific language|details|more information)"),
    ("unknown-license", HINT, "spdx license identifier", r"spdx license identifier"),
]


def _tag(label: str) -> Rule:
    words = " ".join(label.replace("-", " ").replace(".", " ").split())
    return Rule(label, TAG, "spdx license identifier", "spdx license identifier " + words)


#: All rules in order. Of detections that nothing else parts, the earlier rule stays.
RULES = [_tag(label) for label in TAGGED] + [Rule(*row) for row in HAND_WRITTEN]
