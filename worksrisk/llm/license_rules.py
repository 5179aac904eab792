"""Signature rules for license statements, in order of priority.

A rule is (label, priority, keyword, pattern). The keyword stands in every text that the
pattern can match, once that is in lower case and its runs of blanks and signs are single
spaces, and gates the pattern. Patterns are Java regular expressions, read without regard to
ASCII case; ``_`` in them stands for a run of blanks, line ends and comment signs of any length,
taken whole, and ``_?`` for one that may be missing. A detection that lies inside one of higher
priority is suppressed, and so is one inside a longer detection of the same priority.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TAG, NOTICE, VERSION, NAME, HINT = 5, 4, 3, 2, 1
#: How much a detection of each priority counts towards the score.
CONFIDENCE = {TAG: 0.99, NOTICE: 0.95, VERSION: 0.9, NAME: 0.75, HINT: 0.3}


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


SIGNS = r"[\s,*#/;()\-]"


def _rule(label: str, priority: int, keyword: str, pattern: str) -> Rule:
    body = pattern.replace("_", f"(?:{SIGNS}++)")
    return Rule(label, priority, re.sub(SIGNS + "+", " ", keyword),
                rf"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])")


_V = r"(?:v|ver\.?|version)?"

#: Versioned names: label, keyword, name, versions. Each gives a rule per version.
_VERSIONED = [
    ("gpl", "general public license", r"GNU_General_Public_License", ("1", "2", "3")),
    ("gpl", "general public license", r"(?<!Lesser )(?<!Affero )General_Public_License", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:GNU_)?GPL", ("1", "2", "3")),
    ("lgpl", "lesser general public", r"(?:GNU_)?Lesser_General_Public_License", ("2.1", "3")),
    ("lgpl", "library general public", r"(?:GNU_)?Library_General_Public_License", ("2",)),
    ("lgpl", "lgpl", r"(?:GNU_)?LGPL", ("2", "2.1", "3")),
    ("agpl", "affero general public", r"(?:GNU_)?Affero_General_Public_License", ("1", "3")),
    ("agpl", "agpl", r"(?:GNU_)?AGPL", ("1", "3")),
    ("gfdl", "free documentation license", r"(?:GNU_)?Free_Documentation_License", ("1.1", "1.2", "1.3")),
    ("apache", "apache", r"Apache(?:_Software)?_Licen[cs]e", ("1.0", "1.1", "2.0")),
    ("apache", "asl", r"ASL", ("1.1", "2.0")),
    ("mpl", "mozilla public", r"Mozilla_Public_Licen[cs]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"MPL", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public", r"Eclipse_Public_Licen[cs]e", ("1.0", "2.0")),
    ("epl", "epl", r"EPL", ("1.0", "2.0")),
    ("cddl", "common development", r"Common_Development_and_Distribution_Licen[cs]e", ("1.0", "1.1")),
    ("cddl", "cddl", r"CDDL", ("1.0", "1.1")),
    ("cpl", "common public license", r"Common_Public_License", ("1.0",)),
    ("eupl", "european union public", r"European_Union_Public_Licen[cs]e", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", r"EUPL", ("1.0", "1.1", "1.2")),
    ("osl", "open software license", r"Open_Software_License", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free license", r"Academic_Free_License", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic license", r"Artistic_License", ("1.0", "2.0")),
    ("bsl", "boost software", r"Boost_Software_License", ("1.0",)),
    ("ofl", "open font license", r"(?:SIL_)?Open_Font_License", ("1.0", "1.1")),
    ("odbl", "open database license", r"Open_Database_License", ("1.0",)),
    ("cecill", "cecill", r"CeCILL(?:_licen[cs]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("zpl", "zope public", r"Zope_Public_License", ("1.1", "2.0", "2.1")),
    ("php", "php license", r"PHP_License", ("3.0", "3.01")),
    ("psf", "python software foundation", r"Python_Software_Foundation_License", ("2",)),
    ("unicode", "unicode license", r"Unicode_License", ("1", "3")),
    ("mulan", "mulan", r"Mulan_(?:Permissive_Software_License|PSL)", ("1", "2")),
    ("sspl", "server side public", r"Server_Side_Public_License", ("1",)),
    ("busl", "business source license", r"Business_Source_License", ("1.1",)),
    ("elastic", "elastic license", r"Elastic_License", ("1.0", "2.0")),
    ("llama", "llama", r"Llama(?:_\d(?:\.\d)?)?_Community_License(?:_Agreement)?", ("2", "3")),
    ("rail", "rail", r"(?:CreativeML_)?Open_?RAIL(?:-?[MDS]{1,3})?(?:\+\+)?(?:_License)?", ("1",)),
]

#: Creative Commons deeds: short code, long wording.
_CC = [
    ("cc-by", r"Attribution"),
    ("cc-by-sa", r"Attribution_Share_?Alike"),
    ("cc-by-nc", r"Attribution_Non_?Commercial"),
    ("cc-by-nd", r"Attribution_No_?Deriv(?:ative)?s?"),
    ("cc-by-nc-sa", r"Attribution_Non_?Commercial_Share_?Alike"),
    ("cc-by-nc-nd", r"Attribution_Non_?Commercial_No_?Deriv(?:ative)?s?"),
]
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Names without a version.
_NAMES = [
    ("mit", "mit licen", r"MIT_Licen[cs]e"),
    ("mit", "expat", r"Expat_Licen[cs]e"),
    ("mit", "x11", r"(?:MIT/)?X11_Licen[cs]e"),
    ("isc", "isc licen", r"ISC_Licen[cs]e"),
    ("0bsd", "zero-clause bsd", r"Zero_Clause_BSD(?:_Licen[cs]e)?"),
    ("0bsd", "0bsd", r"0BSD"),
    ("bsd-2-clause", "bsd", r"(?:2_Clause|Two_Clause|Simplified|FreeBSD)_BSD(?:_Licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"BSD_2_Clause(?:_Licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:3_Clause|Three_Clause|New|Modified|Revised)_BSD(?:_Licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"BSD_3_Clause(?:_Licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:4_Clause|Four_Clause|Original|Old)_BSD(?:_Licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"BSD_4_Clause(?:_Licen[cs]e)?"),
    ("bsd", "bsd licen", r"BSD_Licen[cs]e"),
    ("bsd", "bsd", r"BSD_style_Licen[cs]e"),
    ("apache", "apache licen", r"Apache_Licen[cs]e"),
    ("apache", "apache software licen", r"Apache_Software_Licen[cs]e"),
    ("gpl", "general public license", r"(?:GNU_)?General_Public_License"),
    ("gpl", "gnu gpl", r"GNU_GPL"),
    ("lgpl", "lesser general public", r"(?:GNU_)?Lesser_General_Public_License"),
    ("agpl", "affero general public", r"(?:GNU_)?Affero_General_Public_License"),
    ("gfdl", "free documentation license", r"(?:GNU_)?Free_Documentation_License"),
    ("mpl", "mozilla public", r"Mozilla_Public_Licen[cs]e"),
    ("epl", "eclipse public", r"Eclipse_Public_Licen[cs]e"),
    ("cddl", "common development", r"Common_Development_and_Distribution_Licen[cs]e"),
    ("eupl", "european union public", r"European_Union_Public_Licen[cs]e"),
    ("artistic", "artistic license", r"Artistic_License"),
    ("zlib", "zlib", r"zlib(?:/libpng)?_Licen[cs]e"),
    ("libpng", "libpng", r"libpng_Licen[cs]e"),
    ("openssl", "openssl", r"OpenSSL_Licen[cs]e"),
    ("ruby", "ruby licen", r"Ruby_Licen[cs]e"),
    ("php", "php licen", r"PHP_Licen[cs]e"),
    ("psf", "python software foundation", r"Python_Software_Foundation_Licen[cs]e"),
    ("postgresql", "postgresql", r"PostgreSQL_Licen[cs]e"),
    ("ncsa", "ncsa", r"(?:University_of_Illinois/)?NCSA(?:_Open_Source)?_Licen[cs]e"),
    ("curl", "curl licen", r"curl_Licen[cs]e"),
    ("vim", "vim licen", r"Vim_Licen[cs]e"),
    ("tcl", "tcl", r"Tcl/?Tk_Licen[cs]e"),
    ("bsl", "boost software", r"Boost_Software_Licen[cs]e"),
    ("ofl", "open font", r"(?:SIL_)?Open_Font_Licen[cs]e"),
    ("odbl", "open database", r"Open_Database_Licen[cs]e"),
    ("odc-by", "open data commons", r"Open_Data_Commons_Attribution_Licen[cs]e"),
    ("pddl", "public domain dedication", r"Public_Domain_Dedication_and_Licen[cs]e"),
    ("cc0", "cc0", r"CC0(?:_1\.0)?(?:_Universal)?"),
    ("cc0", "no rights reserved", r"No_Rights_Reserved"),
    ("cc-pdm", "public domain mark", r"Public_Domain_Mark(?:_1\.0)?"),
    ("public-domain", "public domain", r"(?:in|into|to)_the_public_domain"),
    ("unlicense", "unlicense", r"(?:The_)?Unlicense"),
    ("wtfpl", "wtfpl", r"WTFPL"),
    ("wtfpl", "what the fuck", r"Do_What_The_Fuck_You_Want_To_Public_License"),
    ("beerware", "beer", r"Beer_?ware(?:_Licen[cs]e)?"),
    ("json", "json licen", r"JSON_Licen[cs]e"),
    ("ms-pl", "microsoft public", r"Microsoft_Public_Licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"Microsoft_Reciprocal_Licen[cs]e"),
    ("ijg", "independent jpeg", r"Independent_JPEG_Group_Licen[cs]e"),
    ("ogl", "open government", r"Open_Government_Licen[cs]e"),
    ("commercial", "proprietary", r"proprietary_and_confidential"),
    ("all-rights-reserved", "all rights reserved", r"All_rights_reserved"),
]

#: Wordings of license texts.
_NOTICES = [
    ("mit", "permission is hereby granted", r"Permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy"),
    ("mit", "substantial portions", r"shall_be_included_in_all_copies_or_substantial_portions_of_the_Software"),
    ("isc", "permission to use", r"Permission_to_use_copy_modify_and/?_?or_distribute_this_software_for_any_purpose"),
    ("bsd", "redistribution and use", r"Redistribution_and_use_in_source_and_binary_forms"),
    ("bsd-3-clause", "endorse or promote", r"may_be_used_to_endorse_or_promote_products_derived_from_this_software"),
    ("bsd-4-clause", "advertising materials", r"All_advertising_materials_mentioning_features_or_use"),
    ("bsd-2-clause", "views and conclusions", r"views_and_conclusions_contained_in_the_software"),
    ("apache", "apache", r"Licensed_under_the_Apache_License(?:_Version_2\.0)?"),
    ("apache", "www.apache.org/licenses", r"https?://www\.apache\.org/licenses/LICENSE-2\.0"),
    ("apache", "asf", r"Licensed_to_the_Apache_Software_Foundation_ASF"),
    ("gpl", "gnu general public", r"under_the_terms_of_the_GNU_General_Public_License"),
    ("gpl", "gnu general public", r"received_a_copy_of_the_GNU_General_Public_License"),
    ("gpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl[\w.\-]*"),
    ("lgpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl[\w.\-]*"),
    ("agpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/agpl[\w.\-]*"),
    ("mpl", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/MPL[\w./]*"),
    ("mpl", "mozilla public", r"subject_to_the_terms_of_the_Mozilla_Public_License"),
    ("epl", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/(?:org/)?legal/epl[\w.\-]*"),
    ("mit", "opensource.org/license", r"https?://opensource\.org/licenses?/MIT"),
    ("bsd", "opensource.org/license", r"https?://opensource\.org/licenses?/BSD[\w\-]*"),
    ("cc0", "publicdomain/zero", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-pdm", "publicdomain/mark", r"https?://creativecommons\.org/publicdomain/mark/1\.0"),
    ("unlicense", "free and unencumbered", r"This_is_free_and_unencumbered_software_released_into_the_public_domain"),
    ("zlib", "altered source versions", r"Altered_source_versions_must_be_plainly_marked_as_such"),
    ("bsl", "boost.org/license", r"https?://www\.boost\.org/LICENSE_1_0\.txt".replace("_", "\\x5F")),
    ("warranty-disclaimer", "warranty of any kind", r"provided_\W?AS_IS\W?_without_warranty_of_any_kind"),
    ("copyright", "copyright", r"Copyright_(?:©|\(c\)|c)?_?(?:19|20)\d\d"),
]

#: Identifiers of the public SPDX list that may follow its tag.
_SPDX = ("MIT ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.1 Apache-2.0 GPL-1.0 GPL-2.0 "
         "GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.3 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 "
         "CDDL-1.0 EUPL-1.2 OSL-3.0 AFL-3.0 Artistic-2.0 BSL-1.0 OFL-1.1 ODbL-1.0 Zlib Unlicense "
         "WTFPL CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
         "CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 PostgreSQL NCSA PSF-2.0 PHP-3.01 Python-2.0 "
         "Unicode-3.0 MulanPSL-2.0 SSPL-1.0 BUSL-1.1 Elastic-2.0").split()

_HINTS = [
    ("license-mention", "licen", r"(?:is|are|was)_licen[cs]ed_(?:under|to|by)"),
    ("license-mention", "released under", r"released_under"),
    ("license-mention", "distributed under", r"distributed_under"),
    ("license-mention", "terms of", r"under_the_terms_of_(?:the|this)_licen[cs]e"),
    ("license-mention", "see the licen", r"see_the_LICEN[CS]E_file"),
    ("license-mention", "creative commons", r"Creative_Commons(?:_Licen[cs]e)?"),
]


def rules() -> list[Rule]:
    found = [_rule(i.lower(), TAG, "spdx-license-identifier",
                   rf"SPDX-License-Identifier:\s*+{i.replace('.', '[.]')}(?:-only|-or-later|\+)?")
             for i in _SPDX]
    found += [_rule(label, NOTICE, keyword, text) for label, keyword, text in _NOTICES]
    for label, keyword, name, versions in _VERSIONED:
        for v in versions:
            exact = v.replace(".", "[.]") if "." in v else rf"{v}(?:[.]0)?"
            found.append(_rule(f"{label}-{v}", VERSION, keyword,
                               rf"{name}(?:_{_V}_?|-?v?){exact}(?:\+|_or_(?:any_)?later)?(?![.]\d)"))
    for label, words in _CC:
        for v in _CC_VERSIONS:
            code, exact = label.replace("cc-", "CC_").upper(), v.replace(".", "[.]")
            found.append(_rule(f"{label}-{v}", VERSION, "cc by", rf"{code}_{exact}"))
            found.append(_rule(f"{label}-{v}", VERSION, "attribution",
                               rf"(?:Creative_Commons_)?{words}_{exact}(?:_International|_Unported|_Generic)?"))
        short = label.removeprefix("cc-")
        found.append(_rule(label, NOTICE, f"creativecommons.org/licenses/{short}/",
                           rf"https?://creativecommons\.org/licenses/{short}/[\d.]*"))
        found.append(_rule(label, NAME, "creative commons", rf"Creative_Commons_{words}(?:_Licen[cs]e)?"))
    found += [_rule(label, NAME, keyword, name) for label, keyword, name in _NAMES]
    found += [_rule(label, HINT, keyword, text) for label, keyword, text in _HINTS]
    return sorted(found, key=lambda r: -r.priority)


#: Each keyword holds one of these; a text with none of them has no detection.
ROOTS = ("licen public copyright gpl bsd cc rights permission portions distribut endorse advertis "
         "conclusions asl apache mpl epl cddl eupl attribution creative unencumbered altered "
         "beer wtfpl unlicense x11 expat llama rail mulan cecill proprietary released "
         "terms gnu boost mozilla eclipse common asf warranty fuck python zlib open jpeg tcl ncsa "
         "postgresql libpng microsoft").split()
