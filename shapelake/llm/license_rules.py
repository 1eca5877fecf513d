"""Signatures of licences: names with the forms in which texts state them, and notices.

All patterns are over lower-case words with one blank between them, as
:mod:`shapelake.llm.license_scan` makes them: "Apache-2.0" is "apache 2 0".
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that every scan reports, with the word of each that gates it (its place in the phrase).
BASE = (("cc by", "cc-by", 0), ("general public license", "gpl", 1), ("all rights reserved", "reserved", 2))

#: Words before and after a keyword that a signature can span.
BEFORE, AFTER = 10, 24

_L = "licen[sc]e"
_GNU = "gnu (?:project )?"
_GPL = _GNU + f"general public {_L}"
_LGPL = _GNU + f"(?:lesser|library) general public {_L}"
_AGPL = _GNU + f"affero general public {_L}"
_FDL = _GNU + f"free documentation {_L}"
_VERSION = "(?:version |ver |v )?"
_CC = "creative commons (?:public )?"

#: label, keyword, name (which begins with the keyword), SPDX tag as words (or none),
#: and whether the name says enough without the word licence behind it.
NAMES = (
    ("afl-3.0", "academic", f"academic free {_L}(?: {_VERSION}v?3(?: 0)?)?", "afl 3 0", True),
    ("agpl", "gnu", _AGPL, None, True),
    ("agpl-3.0", "gnu", f"{_AGPL} {_VERSION}v?3(?: 0)?", None, True),
    ("agpl-3.0", "agpl", f"agpl {_VERSION}v?3(?: 0)?", "agpl 3 0", True),
    ("apache", "apache", f"apache(?: software)? {_L}", None, True),
    ("apache-1.0", "apache", f"apache(?: software)?(?: {_L})? {_VERSION}v?1 0", "apache 1 0", True),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {_L})? {_VERSION}v?1 1", "apache 1 1", True),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_L})? {_VERSION}v?2(?: 0)?", "apache 2 0", True),
    ("apsl-2.0", "apple", f"apple public source {_L}(?: {_VERSION}v?2 0)?", None, True),
    ("artistic-1.0", "artistic", f"artistic {_L} {_VERSION}v?1 0", "artistic 1 0", True),
    ("artistic-2.0", "artistic", f"artistic {_L} {_VERSION}v?2 0", "artistic 2 0", True),
    ("beerware", "beerware", "beerware", "beerware", False),
    ("bsd", "bsd", "bsd(?: style| like)?", None, False),
    ("bsd-0-clause", "0bsd", "0bsd", "0bsd", True),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "bsd 2 clause", True),
    ("bsd-2-clause", "simplified", "simplified bsd", None, True),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "bsd 3 clause", True),
    ("bsd-3-clause", "modified", "modified bsd", None, True),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "bsd 4 clause", True),
    ("bsl-1.0", "boost", f"boost software {_L}(?: {_VERSION}v?1 0)?", "bsl 1 0", True),
    ("busl-1.1", "business", f"business source {_L}(?: {_VERSION}v?1 1)?", "busl 1 1", True),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?", "cc0 1 0", True),
    ("cc0-1.0", "creative", f"{_CC}zero(?: v?1 0)?", None, True),
    ("cc-by", "creative", f"{_CC}attribution", None, False),
    ("cc-by-2.0", "cc", "cc by 2 0", "cc by 2 0", True),
    ("cc-by-2.5", "cc", "cc by 2 5", "cc by 2 5", True),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0", True),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0", True),
    ("cc-by-4.0", "creative", f"{_CC}attribution 4 0(?: international)?", None, True),
    ("cc-by-nc", "cc", "cc by nc", None, True),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0", "cc by nc 3 0", True),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", "cc by nc 4 0", True),
    ("cc-by-nc-4.0", "creative", f"{_CC}attribution non ?commercial 4 0(?: international)?", None, True),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0", True),
    ("cc-by-nc-nd", "creative", f"{_CC}attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", None, True),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0", True),
    ("cc-by-nc-sa", "creative", f"{_CC}attribution non ?commercial share ?alike(?: [1-4] [05])?", None, True),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?", "cc by nd 4 0", True),
    ("cc-by-nd", "creative", f"{_CC}attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", None, True),
    ("cc-by-sa", "cc", "cc by sa", None, True),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", "cc by sa 3 0", True),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", "cc by sa 4 0", True),
    ("cc-by-sa-4.0", "creative", f"{_CC}attribution share ?alike 4 0(?: international)?", None, True),
    ("cc-by-sa-3.0", "creative", f"{_CC}attribution share ?alike 3 0(?: unported)?", None, True),
    ("cddl-1.0", "common", f"common development and distribution {_L}(?: {_VERSION}v?1 0)?", None, True),
    ("cddl-1.0", "cddl", "cddl(?: v?1 0)?", "cddl 1 0", True),
    ("cecill-2.1", "cecill", "cecill(?: v?2(?: 1)?)?", "cecill 2 1", True),
    ("cpl-1.0", "common", f"common public {_L}(?: {_VERSION}v?1 0)?", "cpl 1 0", True),
    ("ecl-2.0", "educational", f"educational community {_L}(?: {_VERSION}v?2 0)?", "ecl 2 0", True),
    ("epl-1.0", "eclipse", f"eclipse public {_L}(?: {_VERSION}v?1 0)?", "epl 1 0", True),
    ("epl-2.0", "eclipse", f"eclipse public {_L} {_VERSION}v?2(?: 0)?", "epl 2 0", True),
    ("elastic-2.0", "elastic", f"elastic {_L}(?: {_VERSION}v?2 0)?", "elastic 2 0", True),
    ("eupl-1.1", "european", f"european union public {_L} {_VERSION}v?1 1", "eupl 1 1", True),
    ("eupl-1.2", "european", f"european union public {_L}(?: {_VERSION}v?1 2)?", "eupl 1 2", True),
    ("gfdl-1.2", "gnu", f"{_FDL} {_VERSION}v?1 2", None, True),
    ("gfdl-1.3", "gnu", f"{_FDL}(?: {_VERSION}v?1 3)?", None, True),
    ("gfdl-1.3", "gfdl", "gfdl(?: v?1 3)?", "gfdl 1 3", True),
    ("gpl", "gnu", f"{_GPL}|gnu gpl", None, True),
    ("gpl-1.0", "gnu", f"(?:{_GPL}|gnu gpl) {_VERSION}v?1(?: 0)?", None, True),
    ("gpl-1.0", "gpl", f"gpl {_VERSION}v?1(?: 0)?|gplv1", "gpl 1 0", True),
    ("gpl-2.0", "gnu", f"(?:{_GPL}|gnu gpl) {_VERSION}v?2(?: 0)?", None, True),
    ("gpl-2.0", "gpl", f"gpl {_VERSION}v?2(?: 0)?", "gpl 2 0", True),
    ("gpl-2.0", "gplv2", "gplv2", None, True),
    ("gpl-3.0", "gnu", f"(?:{_GPL}|gnu gpl) {_VERSION}v?3(?: 0)?", None, True),
    ("gpl-3.0", "gpl", f"gpl {_VERSION}v?3(?: 0)?", "gpl 3 0", True),
    ("gpl-3.0", "gplv3", "gplv3", None, True),
    ("hpnd", "historical", "historical permission notice and disclaimer", None, True),
    ("ipl-1.0", "ibm", f"ibm public {_L}(?: {_VERSION}v?1 0)?", "ipl 1 0", True),
    ("isc", "isc", "isc", "isc", False),
    ("json", "json", "json", "json", False),
    ("lgpl", "gnu", f"{_LGPL}|gnu lgpl", None, True),
    ("lgpl-2.0", "gnu", f"(?:{_LGPL}|gnu lgpl) {_VERSION}v?2(?: 0)?", None, True),
    ("lgpl-2.0", "lgpl", f"lgpl {_VERSION}v?2(?: 0)?", "lgpl 2 0", True),
    ("lgpl-2.1", "gnu", f"(?:{_LGPL}|gnu lgpl) {_VERSION}v?2 1", None, True),
    ("lgpl-2.1", "lgpl", f"lgpl {_VERSION}v?2 1", "lgpl 2 1", True),
    ("lgpl-3.0", "gnu", f"(?:{_LGPL}|gnu lgpl) {_VERSION}v?3(?: 0)?", None, True),
    ("lgpl-3.0", "lgpl", f"lgpl {_VERSION}v?3(?: 0)?", "lgpl 3 0", True),
    ("lppl-1.3c", "latex", f"latex project public {_L}(?: {_VERSION}v?1 3c?)?", "lppl 1 3c", True),
    ("mit", "mit", "mit", "mit", False),
    ("mit", "expat", "expat", None, False),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0", True),
    ("mpl", "mozilla", f"mozilla public {_L}", None, True),
    ("mpl-1.0", "mozilla", f"mozilla public {_L} {_VERSION}v?1 0", "mpl 1 0", True),
    ("mpl-1.1", "mozilla", f"mozilla public {_L} {_VERSION}v?1 1", "mpl 1 1", True),
    ("mpl-2.0", "mozilla", f"mozilla public {_L} {_VERSION}v?2(?: 0)?", None, True),
    ("mpl-2.0", "mpl", "mpl v?2(?: 0)?", "mpl 2 0", True),
    ("ms-pl", "microsoft", f"microsoft public {_L}", "ms pl", True),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}", "ms rl", True),
    ("mulanpsl-2.0", "mulan", f"mulan (?:psl|permissive software {_L})(?: {_VERSION}v?2)?", "mulanpsl 2 0", True),
    ("ncsa", "ncsa", "ncsa(?: open source)?", "ncsa", False),
    ("odbl-1.0", "open", f"open (?:data commons open )?database {_L}(?: v?1 0)?", "odbl 1 0", True),
    ("odc-by-1.0", "open", f"open data commons attribution {_L}(?: v?1 0)?", "odc by 1 0", True),
    ("ofl-1.1", "sil", f"sil open font {_L}(?: {_VERSION}v?1 1)?", "ofl 1 1", True),
    ("ogl-3.0", "open", f"open government {_L}(?: v?3 0)?", "ogl uk 3 0", True),
    ("openssl", "openssl", "openssl", "openssl", False),
    ("osl-3.0", "open", f"open software {_L}(?: {_VERSION}v?3 0)?", "osl 3 0", True),
    ("pddl-1.0", "public", f"public domain dedication and {_L}(?: v?1 0)?", "pddl 1 0", True),
    ("php-3.01", "php", "php(?: v?3(?: 01)?)?", "php 3 01", False),
    ("postgresql", "postgresql", "postgresql", "postgresql", False),
    ("psf-2.0", "python", f"python software foundation {_L}(?: {_VERSION}v?2)?", "psf 2 0", True),
    ("qpl-1.0", "q", f"q public {_L}(?: {_VERSION}v?1 0)?", "qpl 1 0", True),
    ("ruby", "ruby", "ruby(?: s)?", "ruby", False),
    ("sspl-1.0", "server", f"server side public {_L}(?: {_VERSION}v?1)?", "sspl 1 0", True),
    ("unlicense", "unlicense", "unlicen[sc]e", "unlicense", True),
    ("upl-1.0", "universal", f"universal permissive {_L}(?: {_VERSION}v?1 0)?", "upl 1 0", True),
    ("vim", "vim", "vim", "vim", False),
    ("w3c", "w3c", "w3c(?: software)?", "w3c", False),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", True),
    ("x11", "x11", "x11", "x11", False),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib", False),
    ("zpl-2.1", "zope", f"zope public {_L}(?: {_VERSION}v?2 1)?", "zpl 2 1", True),
)

#: label, keyword, what stands before it, what begins with it, priority.
NOTICES = (
    ("mit", "granted", "permission is hereby ", "granted free of charge to any person obtaining a copy", 60),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without ", "fee is hereby granted", 60),
    ("bsd", "redistribution", "", "redistribution and use in source and binary forms with or without modification are permitted", 55),
    ("bsd", "redistributions", "", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 54),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ )*?", "endorse or promote products derived from this software", 60),
    ("bsd-4-clause", "advertising", "all ", "advertising materials mentioning features or use of this software", 60),
    ("zlib", "misrepresented", "the origin of this software must not be ", "misrepresented", 60),
    ("unlicense", "unencumbered", "this is free and ", "unencumbered software released into the public domain", 65),
    ("wtfpl", "fuck", "do what the ", "fuck you want to", 60),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public ", "domain", 55),
    ("public-domain", "domain", "is in the public ", "domain", 50),
    ("or-later", "later", "(?:either )?(?:version|v) ?[1-3](?: [01])? (?:of the licen[sc]e )?or at your option any ", "later version", 45),
    ("or-later", "later", "[1-3](?: [01])? or ", "later", 35),
    ("warranty", "warranty", "without ", "warranty of any kind(?: express or implied)?", 25),
    ("warranty", "warranty", "(?:absolutely )?no ", "warranty", 20),
    ("warranty", "merchantability", "", "merchantability (?:and |or )?fitness for a particular purpose", 25),
    ("as-is", "provided", "(?:is )?", "provided as is", 20),
    ("bsd-2-clause", "clause", "2 ", "clause bsd", 51),
    ("bsd-3-clause", "clause", "3 ", "clause bsd", 51),
    ("proprietary", "proprietary", "", "proprietary and confidential", 60),
    ("proprietary", "confidential", "", "confidential and proprietary", 60),
    ("proprietary", "unauthorized", "", "unauthorized (?:copying|use|reproduction|distribution) (?:[^ ]+ ){0,8}?(?:prohibited|forbidden)", 60),
    ("proprietary", "prohibited", "(?:reproduction|copying|distribution|redistribution) (?:[^ ]+ ){0,6}?is (?:strictly )?", "prohibited", 55),
    ("non-commercial", "commercial", "non ", "commercial use only", 50),
    ("non-commercial", "noncommercial", "", "noncommercial use only", 50),
    ("non-commercial", "personal", "for ", "personal use only", 45),
    ("evaluation", "evaluation", "for ", "evaluation (?:purposes|use) only", 45),
    ("dual", "dual", "", "dual licen[sc]ed(?: under)?", 40),
    ("see-license", "license", "see the ", "license file", 15),
    ("see-license", "licence", "see the ", "licence file", 15),
    ("see-license", "copying", "see the (?:file )?", "copying(?: file)? for", 15),
    ("copyright", "copyright", "", "copyright (?:c )?(?:19|20)[0-9]{2}", 15),
    ("copyright", "copr", "", "copr (?:19|20)[0-9]{2}", 15),
    ("contributors", "contributors", "copyright (?:[^ ]+ ){0,6}?and ", "contributors", 18),
    ("spdx", "spdx", "", "spdx licen[sc]e identifier", 30),
    ("attribution", "attribution", "", "attribution required", 30),
    ("no-derivatives", "derivative", "no ", "derivative works?", 30),
    ("share-alike", "alike", "share ", "alike", 30),
    ("patent", "patent", "", "patent (?:grant|licen[sc]e)", 25),
    ("free-software", "free", "this (?:program|library|file) is ", "free software you can redistribute it and or modify it", 45),
    ("open-source", "source", "is open ", "source software", 25),
    ("fair-use", "fair", "", "fair use (?:policy|notice|statement)", 20),
)

_GRANT = " (?:dual )?(?:licensed|licenced|released|distributed|available|published|provided|shared|covered|redistributed) (?:only )?(?:under|by|with) (?:the |a )?(?:terms of |conditions of )?(?:the )?"
_TAG = f" spdx {_L} identifier (?:[a-z0-9]+ ){{0,4}}?"
_LINK = " (?:opensource org|spdx org|choosealicense com|creativecommons org|gnu org|apache org) licen[sc]es "


@dataclass(frozen=True)
class Rule:
    """A signature: what stands right before the ``keyword``, and what begins with it."""

    number: int
    label: str
    keyword: str
    before: str
    after: str
    priority: int


def rules() -> list[Rule]:
    """All signatures, in order: each name by itself, in a grant, behind an SPDX tag and in a link; then the notices.

    A pattern ends at a word's end. ``before`` begins with a blank, or is empty.
    """
    made: list[tuple[str, str, str, str, int]] = []
    for label, keyword, name, tag, enough in NAMES:
        exact = int(any(c.isdigit() for c in label))
        made.append((label, keyword, "", f"(?:{name})" if enough else f"(?:{name}) {_L}", 50 + exact))
        made.append((label, keyword, _GRANT, f"(?:{name})(?: {_L})?(?: (?:only|or later))?", 70 + exact))
        if tag:
            made.append((label, tag.split()[0], _TAG, f"{tag}(?: only| or later)?", 90))
            made.append((label, tag.split()[0], _LINK, f"{tag}(?: html| txt| php)?", 80))
    made += [(label, keyword, f" {before}" if before else "", after, priority) for label, keyword, before, after, priority in NOTICES]
    return [Rule(k, *m) for k, m in enumerate(made)]
