"""Personal data replaced by keyed surrogates of the same kind and format.

An entity (mail address, phone, card, account or social security number, IP address, secret,
name) is brought to a canonical form, so that all ways of writing it share one surrogate: a
phone number is its last ten digits, what stands before them is a country's code and stays. The
surrogate comes from a keyed permutation of all strings of the same layout (letters stay letters
of their case and script, digits digits, check digits hold), so different entities of a layout
can't share one. Long numbers whose check digit is wrong are no cards and stay.

Names begin after a title. Each of their words has a surrogate of its own, by its script, case
and, for given names, the title's gender, so a full name and a short one still belong together;
the words of a text's names are replaced wherever they stand in that text, with a title or
without. What a permutation or a draw can't rule out is checked over the whole corpus: a
surrogate that is itself an entity somewhere, or that two entities share, is drawn again until
none is left.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.common import Scratch, whole_text

#: Titles before a name, by gender and script.
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor", "Sir"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"),
    ("n", "latin"): ("Dr", "Prof"),
    ("m", "cyrillic"): ("г-н", "господин"),
    ("f", "cyrillic"): ("г-жа", "госпожа"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "la", "me", "ni", "ro", "sa", "te", "vi", "zo", "ka", "lu", "ma", "pe"),
    "cyrillic": ("ба", "де", "фи", "го", "ла", "ме", "ни", "ро", "са", "те", "ви", "зо", "ка", "лу", "ма", "пе"),
}
#: Endings of given names by gender, and of family names (of women where the script tells).
ENDINGS = {
    "latin": {"m": "n", "f": "lia", "n": "r", "family": "s", "family of a woman": "s"},
    "cyrillic": {"m": "н", "f": "ва", "n": "р", "family": "ов", "family of a woman": "ова"},
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A capitalised word, perhaps of several parts, of any length.
_WORD = r"[^\W\d_a-zà-ÿа-я](?:[^\W\d_]|['’-](?!s\b)(?=[^\W\d_]))++"
WORD, PART = re.compile(_WORD), re.compile(r"(['’-])")
_TITLE = {t: k for k, ts in TITLES.items() for t in ts}
FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<![A-Za-z])(?i:token|secret|passw(?:or)?d|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z0-9_.~+/=\-]*?[A-Za-z0-9_+/=\-]{12})(?P<secret>[A-Za-z0-9_+/=\-]++(?:[.~]++[A-Za-z0-9_+/=\-]++)*+)"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4})(?!\d))"
    r"|(?<!\w)(?P<title>" + "|".join(map(re.escape, sorted(_TITLE, key=len, reverse=True))) + r")\.?\x20(?:[A-ZА-Я]\.\x20?)*+(?P<name>" + _WORD + r"(?:\x20" + _WORD + r")*+)"
)
#: A text without any of these holds no entity.
HINT = re.compile(r"[@\d]|(?i:secret|token|passw|key)|" + "|".join(map(re.escape, _TITLE)))
KINDS = ("email", "secret", "ip", "phone", "iban", "ssn", "card", "name")
FIELDS = "n_entities long, kinds string, text string"


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, left to right; each word of
    a name is one."""
    if not HINT.search(text):
        return
    found, roles, titled = [], {}, []
    for m in FIND.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        x = m[kind]
        if kind == "name":
            words = [(m.start(kind) + w.start(), w[0]) for w in WORD.finditer(x)]
            gender = _TITLE[m["title"]][0]
            for i, (at, w) in enumerate(words):
                given = i == 0 and len(words) > 1
                titled.append((at, w))
                # what a full name tells of a word counts more than a family name's title
                if given and roles.get(w.lower(), "n") not in ("m", "f"):
                    roles[w.lower()] = gender
                elif not given:
                    roles.setdefault(w.lower(), "family")
        elif kind == "iban":
            c = x.replace(" ", "")
            if remainder(c) == 1:
                found.append((*m.span(kind), kind, c))
        else:
            c = x.lower() if kind == "email" else re.sub(r"\D", "", x) if kind in ("phone", "card", "ssn") else x
            if kind != "card" or luhn(c) == 0:
                found.append((*m.span(kind), kind, c[-10:] if kind == "phone" else c))
    if roles:
        places = dict(titled)
        begins = [f[0] for f in found]
        for w in WORD.finditer(text):
            if w[0].lower() in roles:
                i = bisect_left(begins, w.end())  # the entities before it don't overlap
                if not i or found[i - 1][1] <= w.start():
                    places.setdefault(w.start(), w[0])
        found += [(at, at + len(w), "name", named(w, roles[w.lower()])) for at, w in places.items()]
        found.sort()
    yield from found


def named(word: str, role: str) -> str:
    """The canonical form of a word of a name: script, role and the word, without its case."""
    w = word.lower()
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in w) else "latin"
    if role == "family" and script == "cyrillic" and w[-1] in "ая":
        role = "family of a woman"
    return f"{script}|{role}|{w}"


def remainder(iban: str) -> int:
    """Modulo 97 of an account number, 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Permutation:
    """A keyed permutation without fixed points of the numbers below n (over 1)."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{label}|{n}|{i}".encode(), key=key, digest_size=32).digest() for i in range(8)]

    def _round(self, i: int, x: int) -> int:
        d = hashlib.blake2b(x.to_bytes(self.half // 8 + 1, "big"), key=self.keys[i], digest_size=64).digest()
        while len(d) * 8 < self.half:
            d += hashlib.blake2b(d[-64:], key=self.keys[i], digest_size=64).digest()
        return int.from_bytes(d, "big") & self.mask

    def _walk(self, x: int, back: bool) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(8):
                if back:
                    a, b = b ^ self._round(7 - i, a), a
                else:
                    a, b = b, a ^ self._round(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int, step: int = 1) -> int:
        if self.n < 2:
            return x
        return self._walk((self._walk(x, False) + 1 + (step - 1) % (self.n - 1)) % self.n, True)


#: Most characters that one permutation takes; its time grows with their square.
PIECE = 512
_CLASSES = [(ord("0"), 10), (ord("a"), 26), (ord("A"), 26), (0x430, 32), (0x410, 32)]


def layout(x: str, hexadecimal: bool = False) -> list[tuple[int, int]]:
    """(first code, size) of the class of each character; size 1 for those that stay."""
    if hexadecimal:
        return [(0, 16)] * len(x)
    return [next(((lo, n) for lo, n in _CLASSES if lo <= ord(c) < lo + n), (ord(c), 1)) for c in x]


def permuted(x: str, key: bytes, label: str, step: int) -> str:
    """Another string of the same layout. Long ones are permuted in pieces under a label of the
    whole; that two come to share one is left to the check over the corpus."""
    if len(x) > PIECE:
        own = hashlib.blake2b(x.encode(), key=key, digest_size=16).hexdigest()
        return "".join(permuted(x[i : i + PIECE], key, f"{label}|{own}|{i}", step) for i in range(0, len(x), PIECE))
    hexadecimal = len(x) >= 16 and all(c in "0123456789abcdef" for c in x) and not x.isdigit()
    own = layout(x, hexadecimal)
    number, n = 0, 1
    for c, (lo, size) in zip(x, own):
        number = number * size + (int(c, 16) if hexadecimal else ord(c) - lo)
        n *= size
    mark = "h" * len(x) if hexadecimal else "".join(chr(lo) if size > 1 else c for c, (lo, size) in zip(x, own))
    number = Permutation(key, f"{label}|{mark}", n)(number, step)
    out = []
    for lo, size in reversed(own):
        number, d = divmod(number, size)
        out.append("0123456789abcdef"[d] if hexadecimal else chr(lo + d))
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(kind: str, c: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate of a canonical form."""
    step = attempt + 1
    if kind == "email":
        local, _, domain = c.partition("@")
        head, dot, top = domain.rpartition(".")
        both = permuted(f"{local}@{head}", key, kind, step)
        return f"{both}{dot}{top}"
    if kind == "ip":
        n = 0
        for o in c.split("."):
            n = n << 8 | int(o)
        n = Permutation(key, kind, 1 << 32)(n, step)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        body = permuted(c[:-1], key, f"{kind}{len(c)}", step)
        return body + str(luhn(body + "0") * 9 % 10)
    if kind == "name":
        script, role, x = c.split("|", 2)
        parts = PART.split(x)
        for i in range(0, len(parts), 2):
            # a syllable more on each attempt: however many names there are, the space outgrows them
            d = hashlib.blake2b(f"{c}|{i}|{attempt}".encode(), key=key, digest_size=16 if attempt < 12 else 64).digest()
            parts[i] = "".join(SYLLABLES[script][b % 16] for b in d[: 4 + attempt])
        return f"{script}|{role}|{''.join(parts)}{ENDINGS[script][role]}"
    if kind == "iban":
        body = permuted(c[4:], key, f"{kind}{c[:2]}", step)
        return f"{c[:2]}{98 - remainder(c[:2] + '00' + body):02d}{body}"
    return permuted(c, key, kind, step)


def written(kind: str, shown: str, new: str) -> str:
    """A canonical surrogate in the format of the text it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        keeps = sum(map(str.isalnum, shown)) - len(new)  # a country's code
        signs = iter(new)
        out = []
        for ch in shown:
            if ch.isalnum():
                keeps -= 1
                ch = ch if keeps >= 0 else next(signs)
            out.append(ch)
        return "".join(out)
    if kind == "name":
        parts = PART.split(new.split("|", 2)[2])
        if shown.isupper():
            return "".join(parts).upper()
        return "".join(x.capitalize() for x in parts)
    if kind == "email" and shown.isupper():
        return new.upper()
    return new


def redraws(texts: DataFrame, key: bytes, scratch: Scratch, most: int = 50) -> DataFrame:
    """(t1, t2, again) of the texts that hold entities whose first surrogate collides: a map
    from kind and canonical form to the attempt to use. Empty in all but rare cases."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t1, t2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rows += [(t1, t2, kind, c, surrogate(kind, c, key)) for kind, c in sorted({(k, c) for *_, k, c in find(text.as_py())})]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["t1", "t2", "kind", "c", "new"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, c, key, n) for k, c, n in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.string())], ["kind", "c", "attempt", "new"])

    found = scratch.put(texts.mapInArrow(extract, "t1 long, t2 long, kind string, c string, new string"), "found")
    known = found.groupBy("kind", "c").agg(F.min("new").alias("new")).withColumn("attempt", F.lit(0))
    known = scratch.put(known, "entities-0")
    real = known.select("kind", F.col("c").alias("new")).distinct()
    again = None
    for turn in range(1, most):
        shared = known.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct((F.lit(0) - F.col("attempt")).alias("a"), F.col("c").alias("c"))).alias("first")).where("n > 1")
        taken = known.join(real, ["kind", "new"], "left_semi").select("kind", "c")
        bad = known.join(shared, ["kind", "new"]).where(F.col("c") != F.col("first.c")).select("kind", "c").union(taken).distinct()
        bad = scratch.put(bad, f"bad-{turn}")
        if not bad.head(1):
            break
        redone = known.join(bad, ["kind", "c"]).select("kind", "c", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, "kind string, c string, attempt int, new string")
        known = scratch.put(known.join(bad, ["kind", "c"], "left_anti").select("kind", "c", "new", "attempt").unionByName(redone), f"entities-{turn}")
        again = known.where("attempt > 0")
    else:
        raise RuntimeError(f"surrogates still collide after {most} draws")
    if again is None:
        return None
    of = found.select("t1", "t2", "kind", "c").join(again.select("kind", "c", "attempt"), ["kind", "c"])
    return of.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "c"), "attempt"))).alias("again"))


def pseudonymize(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, n_entities, kinds (sorted, comma-joined)
    and text with every entity replaced.

    One entity has one surrogate in the whole corpus, two entities never share one, and no
    surrogate is an entity of the corpus. Null texts become empty ones. Repeated rows come out
    alike. A surrogate of fewer than two possible values (nothing but signs) stays as it is.
    Entities and texts of any length are read as wholes. A given name is another entity with a
    title of another gender. Extra columns are ignored unless kept.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(*keep, whole_text(docs).alias("_text"))
    hashes = (F.xxhash64("_text").alias("t1"), F.xxhash64(F.lit(1), "_text").alias("t2"))
    again = redraws(rows.select(*hashes, "_text"), key, scratch)
    if again is None:
        rows = rows.withColumn("again", F.lit(None).cast("map<string,int>"))
    else:
        rows = rows.select("*", *hashes).join(again, ["t1", "t2"], "left").select(*keep, "_text", "again")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(FIELDS)])
    n = len(keep)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, attempts in zip(b.column(n), b.column(n + 1)):
                text, at, parts, kinds, count, before = text.as_py(), 0, [], set(), 0, ""
                attempts = dict(attempts.as_py() or ())
                for i, j, kind, c in find(text):
                    new = surrogate(kind, c, key, attempts.get(f"{kind}|{c}", 0))
                    # the words of one name are one entity
                    count += not (kind == before == "name" and text[at:i] == " ")
                    parts += [text[at:i], written(kind, text[i:j], new)]
                    at, before = j, kind
                    kinds.add(kind)
                rows.append((count, ",".join(sorted(kinds)), "".join([*parts, text[at:]])))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string())))], schema.names)

    return rows.mapInArrow(replace, schema)
