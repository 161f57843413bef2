"""Licence scan: Aho-Corasick over identifier tags and notice phrases, and a
shunting-yard parser for licence expressions.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, after
lower-casing A-Z.  One Aho-Corasick pass over a text's words, joined by single spaces,
finds every phrase and tag; phrases may overlap, and of two that begin at one word the
longer one gives the label (base phrases always do).  Behind every identifier tag, from the
next word or parenthesis (on a later line if the tag ends its own) up to the next tag or
the end of that line, a licence expression is read (``MIT OR (Apache-2.0 AND BSD-3-Clause)``,
``GPL-2.0-only WITH Classpath-exception-2.0``): a shunting-yard pass puts it into
postfix order, whose evaluation gives the licences named, the alternatives and whether
a permissive choice is open.  An identifier's label is the longest known family that it
begins with; one of no known family is its own label if it has the form of an identifier
(a digit or hyphen in it).  An expression that does not parse names the licences its known
identifiers name, all of them up to the next tag or the end of the line.  ``License:`` or
``"licence":`` at the beginning of a line is a tag, too, for known identifiers only.

Score: the strength of the best evidence, 1.0 for a parsed tag expression, 0.9 for a
base phrase, 0.8 for another notice phrase, 0.6 for a tag whose expression does not
parse, 0.0 for none.  Null or empty text has no words, no label and score 0.0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ohlcflow.llm.common import id_and_text, small_batches

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases that the method adds, written as words.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution non commercial share alike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "creative commons attribution non commercial no derivatives": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "business source license": "busl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "common development and distribution license": "cddl",
    "sil open font license": "ofl",
    "all rights reserved": "all-rights-reserved",
}
# Identifier tags, written as words.
TAGS = ("spdx license identifier",)
# Metadata keys that are tags where they begin a line and a colon follows.
KEYS = ("license", "licence", "licenses")
# Families of public licence identifiers (prefixes of lower-cased identifiers), each its own label.
FAMILIES = frozenset("""
    0bsd aal afl agpl aladdin apache-1 apache-2 apsl artistic beerware blueoak bsd bsl busl bzip2 cc-by cc-by-nc
    cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl cecill cecill-b cecill-c cpal cpl curl ecl efl elastic epl
    etalab eupl fair fsfap ftl gfdl gpl hpnd icu ijg imagemagick ipl isc json lgpl libpng liliq lppl mit mpl ms-pl ms-rl
    mulanpsl nasa ncsa nist ntp odbl odc-by ofl openssl osl parity pddl php polyform postgresql psf python qpl rpl ruby
    sgi-b sissl sleepycat smlnj sspl tcl ucl unicode unlicense upl vim vsl w3c watcom wtfpl x11 xnet zlib zpl
""".split())
PERMISSIVE = frozenset("""
    0bsd afl apache-1 apache-2 artistic blueoak bsd bsl bzip2 cc-by cc-pddc cc0 curl ecl efl fair fsfap ftl hpnd icu ijg
    imagemagick isc libpng mit mulanpsl ncsa ntp odc-by pddl php postgresql psf python smlnj tcl unicode unlicense upl
    w3c wtfpl x11 xnet zlib zpl
""".split())

SCORES = {"expression": 1.0, "base": 0.9, "notice": 0.8, "tag": 0.6}

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_EXPRESSION = re.compile(r"[0-9A-Za-z(\x80-\U0010ffff][^\n]*")
_TOKEN = re.compile(r"[()]|[0-9A-Za-z][0-9A-Za-z.+:-]*")
_IDENTIFIER = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9-])[0-9A-Za-z][0-9A-Za-z.+-]*")
_LINE_START = re.compile(r"[\r\n][^\r\n]*\Z")
_COLON = re.compile(r"[\"']?[ \t]*:")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    """The text's words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def expressions(text: str, tags: list[tuple[int, int, bool]]) -> Iterator[tuple[str, bool]]:
    """(what stands behind it, whether it is a metadata key) of each tag, given as (number of its first
    word, number of the word behind it, is a key); keys that do not begin a line or have no colon are none."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data.translate(_WORD_BYTES))]
    part = lambda a, z: data[a:z].decode("utf-8", "surrogatepass")

    def is_tag(first: int, behind: int, key: bool) -> bool:
        before = spans[first - 1][1] if first else 0
        after = spans[behind][0] if behind < len(spans) else len(data)
        begins = not first or _LINE_START.search(part(before, spans[first][0]))
        return not key or bool(begins and _COLON.match(part(spans[behind - 1][1], after)))

    tags = [t for t in tags if is_tag(*t)]
    until = [spans[first][0] for first, _, _ in tags[1:]] + [len(data)]
    for (_, behind, key), end in zip(tags, until, strict=False):
        m = _EXPRESSION.search(part(spans[behind - 1][1], end))
        if m:
            yield m[0], key


def family(identifier: str) -> str | None:
    """Label of a licence identifier: the longest known family that it begins with."""
    low = identifier.lower()
    if low in FAMILIES:
        return low
    ends = [i for i, c in enumerate(low) if c in "-+."]
    return next((low[:i] for i in reversed(ends) if low[:i] in FAMILIES), None)


def label_of(identifier: str) -> str | None:
    """Its family, else the identifier itself in lower case if it has the form of one."""
    return family(identifier) or (identifier.lower() if _IDENTIFIER.fullmatch(identifier) else None)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix licence expression to postfix order; None if it does not parse."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for tok in tokens:
        low = tok.lower()
        if low in _PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif tok == "(":
            if not operand_next:
                return None
            held.append(tok)
        elif tok == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(tok)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: list[str], label: Callable = label_of) -> tuple[set[str], bool]:
    """(labels named, a permissive choice is open) of a postfix expression.

    An exception behind WITH loosens its licence and names none itself."""
    stack: list[tuple[set[str], bool, str]] = []
    for tok in expression:
        if tok in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if tok == "with":
                stack.append(left)
            elif tok == "and":
                stack.append((left[0] | right[0], left[1] and right[1], ""))
            else:
                stack.append((left[0] | right[0], left[1] or right[1], ""))
        else:
            name = label(tok)
            stack.append(({name} if name else set(), name in PERMISSIVE, tok))
    names, permissive, _ = stack.pop()
    return names, permissive


def read_expression(line: str, label: Callable = label_of) -> tuple[set[str], bool, bool]:
    """(labels, permissive, parsed) of the text behind an identifier tag.

    Comment closers behind the expression end it, so the longest parsing run of tokens counts."""
    tokens = _TOKEN.findall(line)
    # the expression is the longest prefix of tokens that parses: found in one pass, which ends at the
    # first token that no longer prefix can mend
    end, depth, operand_next = 0, 0, True
    for at, tok in enumerate(tokens, 1):
        operator = tok.lower() in _PRECEDENCE
        if (operator or tok == ")") == operand_next or (tok == ")" and not depth):
            break
        depth += (tok == "(") - (tok == ")")
        operand_next = operator or tok == "("
        if not depth and not operand_next:
            end = at
    best = postfix(tokens[:end])
    if best is None or not any(label(t) for t in best if t not in _PRECEDENCE):
        return {x for t in tokens if (x := family(t))}, False, False
    names, permissive = evaluate(best, label)
    return names, permissive, True


def build_automaton():
    """Aho-Corasick automaton over word-bounded phrases and tags."""
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        entries.setdefault(f" {phrase} ", []).append(("base", label))
    for phrase, label in NOTICE_PHRASES.items():
        entries.setdefault(f" {phrase} ", []).append(("notice", label))
    for kind, tags in (("tag", TAGS), ("key", KEYS)):
        for tag in tags:
            entries.setdefault(f" {tag} ", []).append((kind, ""))
    for pattern, what in entries.items():
        a.add_word(pattern, (len(pattern), what))
    a.make_automaton()
    return a


def scan_text(automaton, text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive)."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    score, permissive = 0.0, False
    hits = list(automaton.iter(joined))
    tags = []
    before = 0  # spaces up to `at`: a phrase's word number, kept up as the hits advance
    at = 0
    longest: dict[int, int] = {}  # end of the longest phrase from a start
    for end, (size, what) in hits:
        if what[0][0] in ("base", "notice"):
            longest[end - size + 1] = max(end, longest.get(end - size + 1, 0))
    for start, end, what in sorted(((end - size + 1, end, what) for end, (size, what) in hits), key=lambda x: x[0]):
        before += joined.count(" ", at, start)
        at = start
        for kind, label in what:
            if kind in ("tag", "key"):
                tags.append((before, before + joined.count(" ", start, end), kind == "key"))
                continue
            if kind == "notice" and end < longest[start]:
                continue
            labels.add(label)
            score = max(score, SCORES[kind])
            permissive |= label in PERMISSIVE
            if kind == "base":
                n_base += 1
                base.add(label)
                first = before if first is None else first
                last = before
    for expression, key in expressions(text, tags) if tags else ():
        names, free, parsed = read_expression(expression, family if key else label_of)
        labels |= names
        permissive |= free
        if names:
            score = max(score, SCORES["expression" if parsed else "tag"])
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, permissive boolean")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and places of base phrases, labels, score, permissive."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.bool_()]
        for b in batches:
            found = [scan_text(automaton, t) for t in b.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) if found else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True)]], names=names)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
