"""Licence notices and identifier tags by Aho-Corasick, with a parser of licence expressions.

One automaton over a text's words, joined by single spaces, finds notice phrases and the tag
words; what follows such a tag in the raw text, up to the end of its line or a sign that no
expression holds, is read as an expression of identifiers joined by AND, OR and WITH and
evaluated by a shunting-yard parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridfold.llm.common import whole_text

#: Phrases of the base, each with its label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases.
MORE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
#: What a licence asks of those who use the text, from 1 (nothing much) down to 0 (no use).
OPENNESS = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc-by": 0.9, "mpl": 0.7, "cc-by-sa": 0.6, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0}
#: The words of an identifier tag, the first perhaps the end of a longer one; how the raw text spells them.
TAG_WORDS = "spdx license identifier "
TAG = re.compile(r"(?i)spdx-license-identifier\s*:\s*([A-Za-z0-9.+()\- \t]+)")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Bytes of words stay, A-Z lower-cased; all others become spaces.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def family(identifier: str) -> str:
    """The label of a licence identifier, e.g. Apache-2.0 -> apache-2, GPL-3.0-or-later -> gpl."""
    x = identifier.lower().rstrip("+")
    for head, label in (("apache-2", "apache-2"), ("mit", "mit"), ("bsd", "bsd"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by")):
        if x == head or x.startswith((head + "-", head + ".")):
            return label
    return x


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if malformed.

    The longest well-formed beginning counts, since prose may follow a tag on its line.
    """
    out: list[str] = []
    stack: list[str] = []
    best: list[str] | None = None
    operand_next, depth = True, 0
    for token in TOKEN.findall(text):
        word = token.lower()
        if operand_next:
            if token == "(":
                stack.append("(")
                depth += 1
                continue
            if token == ")" or word in PRECEDENCE:
                break
            out.append(token.rstrip(".") or token)
            operand_next = False
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
            continue
        else:
            break
        if not depth:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named, and openness: the best of OR's sides, the worst of AND's; WITH keeps the
    licence it modifies."""
    stack: list[tuple[set[str], float]] = []
    for x in postfix:
        if x in PRECEDENCE:
            (b, q), (a, p) = stack.pop(), stack.pop()
            stack.append((a, min(1.0, p + 0.1)) if x == "with" else (a | b, max(p, q) if x == "or" else min(p, q)))
        else:
            label = family(x)
            stack.append(({label}, OPENNESS.get(label, 0.5)))
    return stack[-1]


def automaton(phrases: dict[str, tuple[str, bool]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, (label, base) in phrases.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 1, label, base))
    a.add_word(TAG_WORDS, (3, len(TAG_WORDS) - 1, None, False))
    a.make_automaton()
    return a


def expressions(text: str, line: str, tags: list[int]) -> Iterator[str]:
    """What follows the tags that begin at places of the line of words, in order."""
    raw = text.encode("utf-8", "surrogatepass")
    spans, at, done, chars = WORD.finditer(raw), 0, 0, 0
    for place in tags:
        for _ in range(line.count(" ", at, place)):
            word = next(spans)
        at, start = place, word.end() - len("spdx")
        chars += len(raw[done:start].decode("utf-8", "surrogatepass"))
        done = start
        if found := TAG.match(text, chars):
            yield found[1]


def scan_text(text: str, a: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    base: set[str] = set()
    labels: set[str] = set()
    places: list[int] = []
    tags: list[int] = []
    for end, (_, length, label, is_base) in a.iter(line):
        if label is None:
            tags.append(end - length)
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            places.append(end - length)
    scores = [OPENNESS.get(x, 0.5) for x in labels]
    for expression in expressions(text, line, tags):
        if postfix := to_postfix(expression):
            found, score = evaluate(postfix)
            labels |= found
            scores.append(score)
    n_base = len(places)
    if n_base:
        first, last = line.count(" ", 0, min(places) + 1) - 1, line.count(" ", 0, max(places) + 1) - 1
    else:
        first = last = None
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.5)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, then those of FIELDS.

    Null and empty texts have no words, no places, empty labels and the neutral score 0.5.
    `score` is the openness of the strictest notice found (0.5 if none). Repeated rows are
    scanned each on its own; extra columns are ignored unless kept.
    """
    every = {p: (x, False) for p, x in MORE_PHRASES.items()} | {p: (x, True) for p, x in (BASE_PHRASES if phrases is None else phrases).items()}
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(FIELDS)])
    names, n = schema.names, len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(every)
        types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
        for batch in batches:
            rows = list(zip(*(scan_text(x or "", a) for x in batch.column(n).to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names)

    return docs.select(*keep, whole_text(docs).alias("_text")).mapInArrow(scan, schema)
