"""License scan: an Aho-Corasick automaton over words, and a parser of licence expressions.

A text is reduced to its words, joined by single blanks, and one automaton over that string
reports every place of every phrase, overlapping ones included. Where it meets the words of
an identifier tag, the expressions behind the tags are read from the raw text and evaluated
by a shunting-yard parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases and their labels.
NOTICES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc0": "cc0",
    "all rights reserved": "reserved",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "gnu gpl": "gpl",
    "this is free and unencumbered software": "unlicense",
}

TAG = "spdx license identifier"
_TAGGED = re.compile(r"(?i)spdx-license-identifier[ \t]*:?[ \t]*")
_LINE_END = re.compile(r"[\r\n]")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")

# Family of an identifier by its first part.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl",
    "isc": "isc", "bsl": "bsl", "cc0": "cc0", "cc": "cc", "unlicense": "unlicense", "zlib": "zlib", "0bsd": "bsd",
}

# Public licence identifiers; those of the CC family are made by the rule below.
IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Apache-1.0
Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 Beerware BlueOak-1.0.0 CAL-1.0 CATOSL-1.1
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 CUA-OPL-1.0 ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0
EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa FSFAP FTL Fair Frameworx-1.0 GFDL-1.1 GFDL-1.2
GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPA IPL-1.0 ISC Intel JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 LPL-1.0 LPL-1.02
LPPL-1.3a LPPL-1.3c Latex2e LiLiQ-P-1.1 LiLiQ-R-1.1 Libpng libtiff MIT MIT-0 MIT-Modern-Variant MPL-1.0 MPL-1.1 MPL-2.0 MS-PL
MS-RL MirOS Motosoto MulanPSL-1.0 MulanPSL-2.0 Multics NASA-1.3 NCSA NGPL NPL-1.0 NPL-1.1 NPOSL-3.0 NTP Naumen Nokia OCLC-2.0
ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OGTSL OLDAP-2.8 OSET-PL-2.1 OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0
PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL Ruby SISSL SPL-1.0 SSPL-1.0 SimPL-2.0
Sleepycat TCL UCL-1.0 UPL-1.0 Unicode-DFS-2015 Unicode-DFS-2016 Unlicense VSL-1.0 Vim W3C WTFPL Watcom-1.0 X11 XFree86-1.1 Xnet
ZPL-2.0 ZPL-2.1 Zlib bzip2-1.0.6 curl
""".split()

# Public exceptions that may follow "with".
EXCEPTIONS = """
389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0
CLISP-exception-2.0 eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0 freertos-exception-2.0
GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception i2p-gpl-java-exception Libtool-exception Linux-syscall-note
LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception openvpn-openssl-exception
Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()

_KNOWN = {x.lower(): x for x in IDENTIFIERS}
_EXCEPT = {x.lower(): x for x in EXCEPTIONS}
_CC = re.compile(r"(?i)cc-(by|by-sa|by-nc|by-nd|by-nc-sa|by-nc-nd)-(1\.0|2\.0|2\.5|3\.0|4\.0)")
_VERSIONS = re.compile(r"(?i)((?:a|l)?gpl-\d\.\d|gfdl-\d\.\d)(-only|-or-later)")
_OWN = re.compile(r"(?i)(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: How much a family asks of its user, for evaluating and / or.
DUTIES = {"agpl": 4, "gpl": 3, "lgpl": 2, "mpl": 2, "epl": 2, "cc": 2}

#: What each piece of evidence leaves of the doubt.
DOUBT = 0.4

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


def known_identifier(token: str) -> str | None:
    """The proper form of a public licence identifier or of a reference to one's own; None for any other word."""
    base, plus = (token[:-1], "+") if token.endswith("+") else (token, "")
    if base.lower() in _KNOWN:
        return _KNOWN[base.lower()] + plus
    if _CC.fullmatch(base):
        return base.upper() + plus
    found = _VERSIONS.fullmatch(token)
    if found and found[1].lower() in _KNOWN:
        return _KNOWN[found[1].lower()] + found[2].lower()
    return token if _OWN.fullmatch(token) else None


class Expression:
    """Value of an expression: identifiers in order of first use, the duties it leaves, words that are not known."""

    __slots__ = ("duty", "op", "parts", "unknown")

    def __init__(self, parts: tuple, duty: int, op: str = "", unknown: int = 0):
        self.parts, self.duty, self.op, self.unknown = parts, duty, op, unknown  # identifiers, or expressions that have them

    @property
    def names(self) -> tuple[str, ...]:
        found: dict[str, None] = {}
        left: list = [self]
        while left:
            at = left.pop()
            if isinstance(at, str):
                found[at] = None
            elif at.op == "with":
                left.append(at.parts[0])
            else:
                left += reversed(at.parts)
        return tuple(found)

    def __str__(self) -> str:
        """The expression in proper form: operators in capitals, brackets only where they are needed."""
        out: list[str] = []
        left: list = [self]
        while left:
            at = left.pop()
            if isinstance(at, str):
                out.append(at)
                continue
            parts: list = [at.parts[0]] if at.op else [known_identifier(at.parts[0]) or at.parts[0]]
            for p in at.parts[1:]:
                name = _EXCEPT.get(p.parts[0].lower(), p.parts[0]) if at.op == "with" and not p.op else p
                parts += [f" {at.op.upper()} ", name]
            for p in reversed(parts):
                loose = isinstance(p, Expression) and p.op and _BINDS[p.op] < _BINDS[at.op]
                left += [")", p, "("] if loose else [p]
        return "".join(out)


def _leaf(token: str) -> Expression:
    return Expression((token,), DUTIES.get(family(token) or "", 1), unknown=known_identifier(token) is None)


def family(identifier: str) -> str | None:
    """Family label of a licence identifier; None if it is not known."""
    parts = identifier.lower().rstrip("+").split("-")
    if parts[0] == "cc" and len(parts) > 1:
        return "-".join(["cc", *(p for p in parts[1:] if p.isalpha())])
    return FAMILIES.get(parts[0])


def _joined(op: str, a: Expression, b: Expression) -> Expression:
    if op == "with":  # an exception only lessens what the licence asks
        known = not b.op and b.parts[0].lower() in _EXCEPT and not a.op
        return Expression((a, b), max(a.duty - 1, 1), op, a.unknown + (not known))
    duty = min(a.duty, b.duty) if op == "or" else max(a.duty, b.duty)
    return Expression((a, b), duty, op, a.unknown + b.unknown)


def evaluate(text: str) -> Expression | None:
    """The value of an and / or / with expression; None if it is not well formed.

    Any words may stand for identifiers; ``unknown`` counts those that are no public one.

    ``with`` binds closest, then ``and``, then ``or``; all are left-associative and any case
    is accepted. Parsing stops before the first word that cannot continue the expression.
    """
    values: list[Expression] = []
    operators: list[str] = []
    depth = 0

    def reduce() -> None:
        b, a = values.pop(), values.pop()
        values.append(_joined(operators.pop(), a, b))

    wants_value = True
    for found in _TOKEN.finditer(text):
        token = found[0]
        low = token.lower()
        if wants_value:
            if token == "(":
                operators.append(token)
                depth += 1
            elif token == ")" or low in _BINDS:
                return None
            else:
                values.append(_leaf(token.rstrip(".:")))
                wants_value = False
        elif token == ")":
            if not depth:
                break
            while operators[-1] != "(":
                reduce()
            operators.pop()
            depth -= 1
        elif low in _BINDS:
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[low]:
                reduce()
            operators.append(low)
            wants_value = True
        else:
            break
    if wants_value or depth:
        return None
    while operators:
        reduce()
    return values[0]


def behind_tags(text: str) -> list[str]:
    """What stands behind each tag, up to the next one or the end of the line."""
    tags = list(_TAGGED.finditer(text))
    out = []
    for tag, after in zip(tags, [*(t.start() for t in tags[1:]), len(text)], strict=True):
        line = _LINE_END.search(text, tag.end(), after)
        out.append(text[tag.end() : line.start() if line else after])
    return out


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (phrase, label, False))
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (phrase, label, True))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def scan(text: str | None) -> dict:
    """All that is known of one text; see ``license_scan``."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, starts, labels, notices, tagged = set(), [], set(), 0, False
    at = n_before = 0
    for end, (phrase, label, is_base) in _automaton().iter(flat):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            start = end - len(phrase) - 1
            n_before += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            starts.append(n_before)
            base.add(label)
        else:
            notices += 1
    expressions, normalised, duties, valid = [], [], [], 0
    for found in behind_tags(text) if tagged else []:
        value = evaluate(found)
        expressions.append(found.strip())
        normalised.append(str(value) if value else None)
        duties.append(value.duty if value and not value.unknown else None)
        if value:
            valid += not value.unknown
            labels |= {family(x) for x in value.names if known_identifier(x) and family(x)}
    evidence = len(starts) + notices + 2 * valid
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - DOUBT**evidence if evidence else 0.0,
        "expressions": expressions, "n_valid": valid, "normalised": normalised, "duties": duties,
    }


_KINDS = {
    "n_words": ("long", pa.int64()), "n_base": ("long", pa.int64()), "first_word": ("long", pa.int64()), "last_word": ("long", pa.int64()),
    "base_labels": ("string", pa.string()), "labels": ("string", pa.string()), "score": ("double", pa.float64()),
    "expressions": ("array<string>", pa.list_(pa.string())), "n_valid": ("long", pa.int64()),
    "normalised": ("array<string>", pa.list_(pa.string())), "duties": ("array<int>", pa.list_(pa.int32())),
}


def _scanned(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column(1)]
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in _KINDS.items())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_KINDS])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts, places, labels and expressions of its licences.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; ``n_base``,
    ``first_word`` and ``last_word`` tell of the base phrases only. ``labels`` adds those of
    other notices and of the known identifiers of well-formed expressions; ``expressions`` has the
    text behind each tag up to the next one or the end of the line, ``normalised`` the expression that it
    begins with in proper form (null if it is not well formed), ``duties`` the evaluated one: the
    lesser of ``or``, the greater of ``and``, one less ``with`` an exception, from 1 (notice only) to 4
    (network copyleft), null unless all its identifiers and exceptions are public ones or references
    of one's own. ``n_valid`` counts those that have a duty, ``score`` is the confidence. A null or empty text has no word, empty labels and a score of 0. Null ids and repeated rows
    are returned as they are, and an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scanned, "doc_id long, " + ", ".join(f"{k} {kind}" for k, (kind, _) in _KINDS.items()))
