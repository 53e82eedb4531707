"""Signature rules of licenses and notices: (label, words that every match holds, expression), in the order in which they count.

Expressions are matched against a text's lower-case words with one space between them and cover whole
words. The second entry is the keyword prefilter: every word, or one of those between bars, must be in
the text; the first one is the rarest. Rules of a lower rank number are stronger.
"""

from __future__ import annotations

#: Rank 0: machine-readable tags.
TAGS = [
    ("0bsd", "spdx 0bsd", "spdx license identifier 0bsd"),
    ("afl-3.0", "spdx afl", "spdx license identifier afl 3 0"),
    ("agpl-3.0-only", "spdx agpl only", "spdx license identifier agpl 3 0 only"),
    ("agpl-3.0-or-later", "spdx agpl later", "spdx license identifier agpl 3 0 or later"),
    ("apache-2.0", "spdx apache", "spdx license identifier apache 2 0"),
    ("apache-2.0-llvm", "spdx apache llvm", "spdx license identifier apache 2 0 with llvm exception"),
    ("artistic-2.0", "spdx artistic", "spdx license identifier artistic 2 0"),
    ("bsd-2-clause", "spdx bsd clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx bsd clause", "spdx license identifier bsd 3 clause"),
    ("bsl-1.0", "spdx bsl", "spdx license identifier bsl 1 0"),
    ("busl-1.1", "spdx busl", "spdx license identifier busl 1 1"),
    ("cc0-1.0", "spdx cc0", "spdx license identifier cc0 1 0"),
    ("cc-by-4.0", "spdx cc by", "spdx license identifier cc by 4 0"),
    ("cc-by-sa-4.0", "spdx cc sa", "spdx license identifier cc by sa 4 0"),
    ("cddl-1.0", "spdx cddl", "spdx license identifier cddl 1 0"),
    ("cecill-2.1", "spdx cecill", "spdx license identifier cecill 2 1"),
    ("ecl-2.0", "spdx ecl", "spdx license identifier ecl 2 0"),
    ("epl-1.0", "spdx epl", "spdx license identifier epl 1 0"),
    ("epl-2.0", "spdx epl", "spdx license identifier epl 2 0"),
    ("eupl-1.2", "spdx eupl", "spdx license identifier eupl 1 2"),
    ("gfdl-1.3", "spdx gfdl", "spdx license identifier gfdl 1 3(?: only| or later)?"),
    ("gpl-2.0-only", "spdx gpl only", "spdx license identifier gpl 2 0 only"),
    ("gpl-2.0-or-later", "spdx gpl later", "spdx license identifier gpl 2 0 or later"),
    ("gpl-2.0-classpath", "spdx gpl classpath", "spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0"),
    ("gpl-3.0-only", "spdx gpl only", "spdx license identifier gpl 3 0 only"),
    ("gpl-3.0-or-later", "spdx gpl later", "spdx license identifier gpl 3 0 or later"),
    ("isc", "spdx isc", "spdx license identifier isc"),
    ("lgpl-2.1-only", "spdx lgpl only", "spdx license identifier lgpl 2 1 only"),
    ("lgpl-2.1-or-later", "spdx lgpl later", "spdx license identifier lgpl 2 1 or later"),
    ("lgpl-3.0-only", "spdx lgpl only", "spdx license identifier lgpl 3 0 only"),
    ("lgpl-3.0-or-later", "spdx lgpl later", "spdx license identifier lgpl 3 0 or later"),
    ("mit", "spdx mit", "spdx license identifier mit"),
    ("mit-0", "spdx mit 0", "spdx license identifier mit 0"),
    ("mpl-2.0", "spdx mpl", "spdx license identifier mpl 2 0"),
    ("ms-pl", "spdx ms pl", "spdx license identifier ms pl"),
    ("ncsa", "spdx ncsa", "spdx license identifier ncsa"),
    ("ofl-1.1", "spdx ofl", "spdx license identifier ofl 1 1"),
    ("osl-3.0", "spdx osl", "spdx license identifier osl 3 0"),
    ("postgresql", "spdx postgresql", "spdx license identifier postgresql"),
    ("psf-2.0", "spdx psf|python", "spdx license identifier (?:psf|python) 2 0"),
    ("sspl-1.0", "spdx sspl", "spdx license identifier sspl 1 0"),
    ("unlicense", "spdx unlicense", "spdx license identifier unlicense"),
    ("upl-1.0", "spdx upl", "spdx license identifier upl 1 0"),
    ("wtfpl", "spdx wtfpl", "spdx license identifier wtfpl"),
    ("zlib", "spdx zlib", "spdx license identifier zlib"),
    ("zpl-2.1", "spdx zpl", "spdx license identifier zpl 2 1"),
    ("spdx-tag", "spdx identifier", "spdx license identifier [a-z0-9]+"),
]

#: Rank 1: names with a version.
VERSIONED = [
    ("afl-3.0", "license|licence academic", "academic free licen[cs]e(?: version| v)? 3 0"),
    ("agpl-3.0", "affero gnu", "gnu affero general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)?"),
    ("agpl-3.0-or-later", "affero later", "gnu affero general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)? or(?: at your option)? any later version"),
    ("agpl-3.0", "agpl|agplv3|agpl3", "(?:gnu )?(?:agplv3|agpl3|agpl(?: v| version)? (?:v3|3)(?: 0)?)"),
    ("apache-1.1", "apache 1", "apache(?: software)? licen[cs]e(?: version| v)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? (?:v2|2)(?: 0)?"),
    ("apache-2.0", "apache", "apache (?:v2|2)(?: 0)?(?: licen[cs]ed?)?"),
    ("apache-2.0", "asl", "asl 2 0"),
    ("artistic-1.0", "license|licence artistic", "artistic licen[cs]e(?: version| v)? 1 0"),
    ("artistic-2.0", "license|licence artistic", "artistic licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("bsd-2-clause", "bsd clause", "(?:2|two) clause(?: simplified| freebsd)? bsd(?: licen[cs]ed?)?"),
    ("bsd-2-clause", "bsd clause", "bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd clause", "(?:3|three) clause(?: new| revised| modified)? bsd(?: licen[cs]ed?)?"),
    ("bsd-3-clause", "bsd clause", "bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd clause", "(?:4|four) clause(?: original)? bsd(?: licen[cs]ed?)?"),
    ("bsl-1.0", "license|licence boost", "boost software licen[cs]e(?: version| v)? 1 0"),
    ("busl-1.1", "license|licence business", "business source licen[cs]e(?: version| v)? 1 1"),
    ("cc0-1.0", "cc0", "cc0(?: version)? 1 0(?: universal)?"),
    ("cc-by-1.0", "cc by", "cc by 1 0"),
    ("cc-by-2.0", "cc by", "cc by 2 0"),
    ("cc-by-2.5", "cc by", "cc by 2 5"),
    ("cc-by-3.0", "cc by", "cc by 3 0(?: [a-z]{2})?"),
    ("cc-by-4.0", "cc by", "cc by 4 0"),
    ("cc-by-nc-2.0", "cc nc", "cc by nc 2 0"),
    ("cc-by-nc-3.0", "cc nc", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc nc", "cc by nc 4 0"),
    ("cc-by-nc-nd-3.0", "cc nd", "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "cc nd", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-3.0", "cc sa", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "cc sa", "cc by nc sa 4 0"),
    ("cc-by-nd-3.0", "cc nd", "cc by nd 3 0"),
    ("cc-by-nd-4.0", "cc nd", "cc by nd 4 0"),
    ("cc-by-sa-2.5", "cc sa", "cc by sa 2 5"),
    ("cc-by-sa-3.0", "cc sa", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc sa", "cc by sa 4 0"),
    ("cc-by-4.0", "commons attribution", "creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-3.0", "commons attribution", "creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-nc-4.0", "noncommercial|commercial commons", "creative commons attribution (?:noncommercial|non commercial) 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", "noncommercial|commercial commons", "creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives) 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", "noncommercial|commercial commons", "creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike) 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", "sharealike|alike commons", "creative commons attribution (?:sharealike|share alike) 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-3.0", "sharealike|alike commons", "creative commons attribution (?:sharealike|share alike) 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-nd-4.0", "noderivatives|derivatives commons", "creative commons attribution (?:noderivatives|no derivatives) 4 0(?: international)?(?: licen[cs]e)?"),
    ("cddl-1.0", "cddl|distribution", "(?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1 0"),
    ("cddl-1.1", "cddl|distribution", "(?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1 1"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 1"),
    ("cecill-b", "cecill", "cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill", "cecill c(?: licen[cs]e)?"),
    ("cpl-1.0", "license|licence common", "common public licen[cs]e(?: version| v)? 1 0"),
    ("ecl-2.0", "license|licence educational", "educational community licen[cs]e(?: version| v)? 2 0"),
    ("epl-1.0", "license|licence eclipse", "eclipse public licen[cs]e(?: version| v)? 1 0"),
    ("epl-2.0", "license|licence eclipse", "eclipse public licen[cs]e(?: version| v)? (?:v2|2)(?: 0)?"),
    ("eupl-1.1", "eupl|license|licence", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 1"),
    ("eupl-1.2", "eupl|license|licence", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 2"),
    ("gfdl-1.2", "license|licence documentation gnu", "gnu free documentation licen[cs]e(?: version| v)? 1 2"),
    ("gfdl-1.3", "license|licence documentation gnu", "gnu free documentation licen[cs]e(?: version| v)? 1 3"),
    ("gpl-1.0", "gnu", "gnu general public licen[cs]e(?: version| v)? (?:v1|1)(?: 0)?"),
    ("gpl-2.0", "gnu", "gnu general public licen[cs]e(?: version| v)? (?:v2|2)(?: 0)?"),
    ("gpl-2.0-only", "gnu only", "gnu general public licen[cs]e(?: version| v)? (?:v2|2)(?: 0)? only"),
    ("gpl-2.0-or-later", "gnu later", "gnu general public licen[cs]e(?: version| v)? (?:v2|2)(?: 0)? or(?: at your option)? any later version"),
    ("gpl-2.0-or-later", "gnu later", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or(?: at your option)? any later version"),
    ("gpl-3.0", "gnu", "gnu general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)?"),
    ("gpl-3.0-only", "gnu only", "gnu general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)? only"),
    ("gpl-3.0-or-later", "gnu later", "gnu general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)? or(?: at your option)? any later version"),
    ("gpl-3.0-or-later", "gnu later", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or(?: at your option)? any later version"),
    ("gpl-2.0", "gpl|gplv2|gpl2", "(?:gnu )?(?:gplv2|gpl2|gpl(?: v| version)? (?:v2|2)(?: 0)?)"),
    ("gpl-2.0-or-later", "gpl|gplv2|gpl2 later", "(?:gnu )?(?:gplv2|gpl2|gpl(?: v| version)? (?:v2|2)(?: 0)?) or later"),
    ("gpl-3.0", "gpl|gplv3|gpl3", "(?:gnu )?(?:gplv3|gpl3|gpl(?: v| version)? (?:v3|3)(?: 0)?)"),
    ("gpl-3.0-or-later", "gpl|gplv3|gpl3 later", "(?:gnu )?(?:gplv3|gpl3|gpl(?: v| version)? (?:v3|3)(?: 0)?) or later"),
    ("lgpl-2.0", "license|licence library gnu", "gnu library general public licen[cs]e(?: version| v)? (?:v2|2)(?: 0)?"),
    ("lgpl-2.1", "license|licence lesser gnu", "gnu lesser general public licen[cs]e(?: version| v)? (?:v2|2) 1"),
    ("lgpl-2.1-or-later", "license|licence lesser later", "gnu lesser general public licen[cs]e(?: version| v)? (?:v2|2) 1 or(?: at your option)? any later version"),
    ("lgpl-3.0", "license|licence lesser gnu", "gnu lesser general public licen[cs]e(?: version| v)? (?:v3|3)(?: 0)?"),
    ("lgpl-2.1", "lgpl|lgplv2", "(?:gnu )?(?:lgplv2|lgpl(?: v| version)? (?:v2|2)) 1"),
    ("lgpl-3.0", "lgpl|lgplv3|lgpl3", "(?:gnu )?(?:lgplv3|lgpl3|lgpl(?: v| version)? (?:v3|3)(?: 0)?)"),
    ("lppl-1.3c", "lppl|license|licence", "(?:latex project public licen[cs]e|lppl)(?: version| v)? 1 3c?"),
    ("mpl-1.0", "mozilla|mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? 1 0"),
    ("mpl-1.1", "mozilla|mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla|mpl", "(?:mozilla public licen[cs]e(?: version| v)?|mpl(?: version| v)?) (?:v2|2)(?: 0)?"),
    ("mulan-2.0", "mulan", "mulan(?: psl| permissive software licen[cs]e)(?: version| v)? (?:v2|2)(?: 0)?"),
    ("npl-1.1", "license|licence netscape", "netscape public licen[cs]e(?: version| v)? 1 1"),
    ("odbl-1.0", "odbl|license|licence", "(?:open database licen[cs]e(?: odbl)?|odbl)(?: version| v)? 1 0"),
    ("odc-by-1.0", "odc|license|licence", "(?:open data commons attribution licen[cs]e|odc by)(?: version| v)? 1 0"),
    ("ofl-1.1", "ofl|license|licence", "(?:sil open font licen[cs]e|ofl)(?: version| v)? 1 1"),
    ("osl-3.0", "license|licence open software", "open software licen[cs]e(?: version| v)? 3 0"),
    ("pddl-1.0", "pddl|license|licence", "(?:public domain dedication and licen[cs]e|pddl)(?: version| v)? 1 0"),
    ("php-3.01", "license|licence php", "php licen[cs]e(?: version| v)? 3 01"),
    ("psf-2.0", "license|licence python|psf", "(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: version| v)? 2(?: 0)?"),
    ("qpl-1.0", "qpl|license|licence", "(?:q public licen[cs]e|qpl)(?: version| v)? 1 0"),
    ("sspl-1.0", "sspl|license|licence", "(?:server side public licen[cs]e|sspl)(?: version| v)? 1(?: 0)?"),
    ("upl-1.0", "upl|license|licence", "(?:universal permissive licen[cs]e|upl)(?: version| v)? 1 0"),
    ("w3c-20150513", "w3c", "w3c software and document(?: notice and)? licen[cs]e"),
    ("wtfpl-2", "wtfpl", "wtfpl(?: version| v)? 2"),
    ("zpl-2.1", "zope|zpl", "(?:zope public licen[cs]e|zpl)(?: version| v)? 2 1"),
]

#: Rank 2: names without a version.
NAMED = [
    ("afl", "license|licence academic", "academic free licen[cs]e"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("apache", "apache", "apache(?: software)? licen[cs]ed?"),
    ("apsl", "license|licence apple", "apple public source licen[cs]e"),
    ("license|licence artistic", "license|licence artistic", "(?:perl )?artistic licen[cs]e"),
    ("beerware", "beerware|beer", "(?:beerware|beer ware) licen[cs]e"),
    ("bittorrent", "bittorrent", "bittorrent open source licen[cs]e"),
    ("license|licence boost", "license|licence boost", "boost(?: software)? licen[cs]e"),
    ("bsd", "bsd", "(?:new |modified |simplified |original |berkeley )?bsd(?: style)? licen[cs]ed?"),
    ("bsd", "berkeley", "berkeley software distribution licen[cs]e"),
    ("busl", "license|licence business", "business source licen[cs]e"),
    ("cc0", "cc0", "(?:creative commons )?cc0(?: public domain)?(?: dedication)?"),
    ("cc-by", "commons attribution", "creative commons attribution(?: licen[cs]e)?"),
    ("cc-by-nc", "cc nc", "cc by nc"),
    ("cc-by-nc-nd", "cc nd", "cc by nc nd"),
    ("cc-by-nc-sa", "cc sa", "cc by nc sa"),
    ("cc-by-nd", "cc nd", "cc by nd"),
    ("cc-by-sa", "cc sa", "cc by sa"),
    ("cc-by-nc", "noncommercial|commercial commons", "creative commons attribution (?:noncommercial|non commercial)(?: licen[cs]e)?"),
    ("cc-by-sa", "sharealike|alike commons", "creative commons attribution (?:sharealike|share alike)(?: licen[cs]e)?"),
    ("creative-commons", "creative commons", "creative commons(?: public)?(?: licen[cs]ed?)?"),
    ("cddl", "cddl", "cddl"),
    ("cecill", "cecill", "cecill"),
    ("commons-clause", "clause commons", "commons clause(?: licen[cs]e)?(?: condition)?"),
    ("cpal", "cpal|license|licence", "(?:common public attribution licen[cs]e|cpal)"),
    ("cpl", "license|licence common", "common public licen[cs]e"),
    ("curl", "curl", "curl licen[cs]e"),
    ("ecl", "license|licence educational", "educational community licen[cs]e"),
    ("license|licence elastic", "license|licence elastic", "elastic licen[cs]e(?: (?:v2|2 0))?"),
    ("epl", "license|licence eclipse", "eclipse(?: public)? licen[cs]e"),
    ("eupl", "eupl|license|licence", "(?:european union public licen[cs]e|eupl)"),
    ("freetype", "freetype", "freetype(?: project)? licen[cs]e"),
    ("gfdl", "gfdl|license|licence", "(?:gnu free documentation licen[cs]e|gfdl)"),
    ("gpl", "gnu", "gnu general public licen[cs]e"),
    ("gpl", "gnu", "gnu public licen[cs]e"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: licen[cs]ed?)?"),
    ("hpnd", "historical disclaimer", "historical permission notice and disclaimer"),
    ("ibm-ipl", "license|licence ibm", "ibm public licen[cs]e"),
    ("icu", "icu", "icu licen[cs]e"),
    ("ijg", "license|licence jpeg", "independent jpeg group(?: s)? licen[cs]e"),
    ("license|licence intel", "license|licence intel", "intel open source licen[cs]e"),
    ("isc", "isc", "isc licen[cs]ed?"),
    ("jasper", "jasper", "jasper licen[cs]e"),
    ("license|licence json", "license|licence json", "json licen[cs]e"),
    ("lgpl", "license|licence lesser|library", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("libtiff", "libtiff", "libtiff licen[cs]e"),
    ("lppl", "lppl|license|licence", "(?:latex project public licen[cs]e|lppl)"),
    ("lucent", "lucent", "lucent public licen[cs]e"),
    ("miros", "miros", "miros licen[cs]e"),
    ("mit", "license|licence|licensed|licenced mit", "mit(?: x11| expat| style)? licen[cs]ed?"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mit-0", "attribution mit", "mit no attribution(?: licen[cs]e)?"),
    ("motosoto", "motosoto", "motosoto open source licen[cs]e"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("ms-pl", "license|licence microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "license|licence microsoft", "microsoft reciprocal licen[cs]e"),
    ("mulan", "mulan", "mulan(?: psl| permissive software licen[cs]e)"),
    ("nasa", "nasa", "nasa open source agreement"),
    ("ncsa", "ncsa|illinois", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("netcdf", "netcdf", "netcdf licen[cs]e"),
    ("nokia", "nokia", "nokia open source licen[cs]e"),
    ("npl", "license|licence netscape", "netscape public licen[cs]e"),
    ("oclc", "oclc", "oclc research public licen[cs]e"),
    ("odbl", "odbl|license|licence", "(?:open database licen[cs]e|odbl)"),
    ("odc-by", "odc", "odc by"),
    ("ofl", "ofl|license|licence", "(?:sil )?open font licen[cs]e|ofl"),
    ("ogl", "license|licence government", "open government licen[cs]e"),
    ("openssl", "openssl", "openssl(?: ssleay)? licen[cs]e"),
    ("osl", "license|licence open software", "open software licen[cs]e"),
    ("pddl", "pddl", "pddl"),
    ("perl terms", "perl terms", "same terms as perl(?: itself)?"),
    ("license|licence php", "license|licence php", "php licen[cs]e"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)(?: licen[cs]e)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("psf", "license|licence python|psf", "(?:python software foundation|psf) licen[cs]e"),
    ("public-domain", "domain public", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("qpl", "qpl", "qpl"),
    ("realnetworks", "realnetworks", "realnetworks public source licen[cs]e"),
    ("license|licence ruby", "license|licence ruby", "ruby licen[cs]e"),
    ("sgi-b", "sgi", "sgi free software licen[cs]e b"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("sspl", "sspl|license|licence", "(?:server side public licen[cs]e|sspl)"),
    ("license|licence sun", "license|licence sun", "sun (?:public|industry standards source) licen[cs]e"),
    ("tcl", "tcl", "tcl tk licen[cs]e"),
    ("unicode terms|licence|license", "unicode terms|licence|license", "unicode(?: terms of use| licen[cs]e agreement| data files and software licen[cs]e)"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("upl", "license|licence universal", "universal permissive licen[cs]e"),
    ("license|licence vim", "license|licence vim", "vim licen[cs]e"),
    ("vovida", "vovida", "vovida software licen[cs]e"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[cs]e"),
    ("wtfpl", "wtfpl|fuck", "(?:wtfpl|do what the fuck you want to public licen[cs]e)"),
    ("wxwindows", "wxwindows", "wxwindows library licen[cs]e"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("xfree86", "xfree86", "xfree86 licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("zpl", "zope", "zope public licen[cs]e"),
]

#: Rank 3: sentences of license texts.
SENTENCES = [
    ("agpl", "remotely network interact|interacting", "interact(?:ing)? with it remotely through a computer network"),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0"),
    ("apache-2.0", "compliance license file", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "governing limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse promote", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising mentioning", "all advertising materials mentioning features or use of this software"),
    ("bsl-1.0", "boost org", "www boost org license 1 0 txt"),
    ("cc", "creativecommons", "creativecommons org (?:licenses|publicdomain) [a-z0-9]+"),
    ("cc0", "waived neighboring", "waived all copyright and related or neighboring rights"),
    ("epl", "eclipse org", "www eclipse org legal epl v[12]0?(?: html)?"),
    ("gpl", "redistribute gnu", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu org", "www gnu org (?:licenses|copyleft)(?: gpl(?: html)?)?"),
    ("gpl", "gnu details", "see the gnu general public licen[cs]e for more details"),
    ("isc", "hereby permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "redistribute lesser", "redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("mit", "hereby permission charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "opensource mit", "opensource org licenses mit"),
    ("mpl-2.0", "mozilla mpl", "mozilla org mpl 2 0"),
    ("mpl", "mozilla subject", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("ofl", "font sold", "the font software may not be sold by itself"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("warranty-disclaimer", "warranty|warranties", "without(?: any)? warrant(?:y|ies) of any kind"),
    ("warranty-disclaimer", "merchantability", "merchantability (?:and|or) fitness for a particular purpose"),
    ("liability-disclaimer", "liable event", "in no event shall(?: [^ ]+){1,8} be liable"),
]

#: Rank 4: notices that name no license.
NOTICES = [
    ("all-rights-reserved", "reserved rights", "all rights(?: are)? reserved"),
    ("some-rights-reserved", "reserved rights", "some rights reserved"),
    ("copyright-notice", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: [^ ]+){0,3}"),
    ("confidential", "confidential proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("license|licence proprietary", "license|licence proprietary", "proprietary(?: software)? licen[cs]e"),
    ("eula", "license|licence user agreement", "end user licen[cs]e agreement"),
    ("non-commercial", "commercial non", "(?:for|only for|strictly for) non commercial (?:use|purposes)(?: only)?"),
    ("no-redistribution", "redistribution|reproduction", "(?:redistribution|reproduction)(?: is)? prohibited"),
    ("no-training", "training used", "may not be used (?:for|to)(?: machine learning| ai| model)? training"),
    ("licensed-under", "licensed|licenced", "licen[cs]ed under(?: the)?(?: terms of)?(?: the)? [a-z0-9]+"),
    ("released-under", "license|licence released", "released under(?: the)?(?: terms of)?(?: the)? [a-z0-9]+ licen[cs]e"),
    ("see-license", "license", "see(?: the)? license(?: file)? for(?: more)? details"),
    ("see-license", "license", "see license (?:txt|md)"),
]
