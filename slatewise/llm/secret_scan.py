"""Secrets in texts: fixed patterns, and an assignment-aware lexer for named literals.

The lexer reads source and configuration syntax (`name = "x"`, `"name": "x"`,
`name: x`, `name => 'x'`, `:=`, `export NAME=x`, `<name>x</name>`) into pairs of a
target name and literals, joins literals put together with `+` or by adjacency,
and follows names: a literal assigned to a plain name counts for every target the
name is assigned to later. A literal is scored by how sensitive its target's name
is and by its own length, variety and mix of characters. Literals put together are
chains that share their parts and carry the counts their score needs, and a quote
sign that nothing closes is looked up once a line, so the work is linear in the text
(times the number of different characters in a followed literal).

A span is (kind, start, end) in code points. Pattern kinds are `assign`, `access`
and `hex`; literals that lie in none of their spans are added as `literal`.

Defined cases: a NULL or empty text has no spans; repeated rows are scanned each;
a name assigned twice holds its last literal; unclosed quotes end with the line;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")

#: The base patterns, and the least length of what they have to hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: How sensitive a name is, by its parts; and values that stand for no secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.8,
             "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.7, "authorization": 0.6, "auth": 0.5}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0,
                   ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("account", "key"): 0.8, ("client", "secret"): 1.0}
HARMLESS_WHOLE = {"true", "false", "none", "null", "nil", "undefined", "example", "changeme", "password", "secret", "token", "test", "todo"}
HARMLESS_STARTS = ("<", "$", "%", "{", "your_", "your-", "os.", "env.", "process.")
HARMLESS_INSIDE = ("example", "placeholder", "redacted")
THRESHOLD = 1.0

_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_INSIDE = {q: re.compile(rf"[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+") for q in "\"'`"}
_LEX = re.compile(
    r"""<(?P<tag>[A-Za-z_][\w.-]*+)>(?P<inner>[^<>\n]*+)</(?P=tag)>"""
    r"""|(?P<name>[^\W\d][\w.-]*)|(?P<set>:=|=>|==|!=|<=|>=|=|:)|(?P<plus>\+)|(?P<end>[\n;,(){}\[\]])|(?P<gap>[^\S\n]+)|(?P<odd>.)""")
_BARE = re.compile(r"[^\S\n]*([A-Za-z0-9+/_.=@!#%^&*~-]++)(?P<last>[^\S\n]*+(?:\n|$|#|;))?")


@lru_cache(4096)
def sensitivity(name: str) -> float:
    """How likely a target of this name holds a secret, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    single = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max(single, max((SENSITIVE_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:])), default=0.0))


class Chain:
    """A literal, or two chains put together.

    Character counts, the two ends (enough of them for the longest harmless word), the
    kinds of characters and whether a harmless word lies inside come from the parts, so a chain
    costs as much as its different characters, however long it is. Counts of very long
    chains are scaled; only their shares matter then.
    """

    __slots__ = ("parts", "span", "text", "n", "counts", "head", "tail", "kinds", "harmless", "taken")
    ENDS = max(map(len, HARMLESS_INSIDE)) + 1

    def __init__(self, parts=None, span=None, text=None):
        self.parts, self.span, self.text, self.counts, self.taken = parts, span, text, None, False
        if parts:
            self._join(*[x.measured() for x in parts])

    def measured(self):
        if self.counts is None:
            text = self.text
            self.n, self.counts = len(text), dict(Counter(text))
            low = text.lower()
            self.head, self.tail = low[:self.ENDS], low[-self.ENDS:]
            self.kinds = 0
            for c in self.counts:
                self.kinds |= _kind(c)
            self.harmless = _harmless(low)
        return self

    def _join(self, left, right):
        self.n, counts = left.n + right.n, dict(left.counts)
        for c, k in right.counts.items():
            counts[c] = counts.get(c, 0) + k
        self.counts = counts
        if self.n > 1e9:
            self.counts = {c: k * (1e6 / self.n) for c, k in counts.items()}
            self.n = 1e6
        self.head = left.head if len(left.head) == self.ENDS else (left.head + right.head)[:self.ENDS]
        self.tail = right.tail if len(right.tail) == self.ENDS else (left.tail + right.tail)[-self.ENDS:]
        self.kinds = left.kinds | right.kinds
        self.harmless = left.harmless or right.harmless or _harmless(left.tail + right.head)

    def strength(self) -> float:
        """How much the literal looks like a secret: bits of variety, with a share for mixed kinds of characters."""
        self.measured()
        n, head = self.n, self.head
        if n < 8 or self.kinds & BLANK or self.harmless or head.startswith(HARMLESS_STARTS):
            return 0.0
        if (n == len(head) and head in HARMLESS_WHOLE) or (len(self.counts) < 4 and len({c.lower() for c in self.counts}) == 1):
            return 0.0
        bits = -sum([c / n * math.log2(c / n) for c in self.counts.values()])
        return min(1.0, bits / 4) * (0.4 + 0.2 * self.kinds.bit_count())

    def spans(self) -> list[tuple[int, int]]:
        """Spans of the literals in it that no call has returned yet."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if not x.taken:
                x.taken = True
                todo += x.parts or ()
                if x.span and x.span[0] < x.span[1]:
                    out.append(x.span)
        return out


BLANK = 16


def _kind(c: str) -> int:
    """One bit for each kind of character."""
    if c.isspace():
        return BLANK
    return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8


def _harmless(low: str) -> bool:
    return any([w in low for w in HARMLESS_INSIDE])


def pairs(text: str):
    """(name, chain) of every assignment in the text, names followed to their literals."""
    held: dict[str, Chain] = {}
    unclosed = dict.fromkeys(_INSIDE, 0)
    target, chain, mode, last = None, None, "", None
    at, n, passed = 0, len(text), 0
    while at < n:
        sign, body = text[at], None
        if sign in _INSIDE and at >= unclosed[sign]:
            stop = _INSIDE[sign].match(text, at + 1).end()
            if stop < n and text[stop] == sign:
                body, at = (at + 1, stop), stop + 1
            else:
                unclosed[sign] = stop  # a later one before that place runs into the same end
        if body:
            if target is not None and mode == "value":
                more = Chain(span=body, text=text[body[0]:body[1]])
                chain = more if chain is None else Chain((chain, more))
            last = text[body[0]:body[1]]
            continue
        m = _LEX.match(text, at)
        kind, at = m.lastgroup, m.end()
        if m["tag"] is not None:
            yield m["tag"], Chain(span=m.span("inner"), text=m["inner"])
            continue
        if kind == "gap":
            continue
        if kind == "end":
            if target is not None and chain is not None:
                held[target] = chain
                yield target, chain
            target, chain, mode, last = None, None, "", None
        elif kind == "set":
            if m[0] in ("=", ":=", ":", "=>") and last is not None:
                if target is not None and chain is not None:
                    held[target] = chain
                    yield target, chain
                target, chain, mode = last, None, "value"
                bare = _BARE.match(text, m.end()) if m.end() >= passed else None
                if bare and bare["last"] is not None and bare[1] not in held:
                    chain, mode, at = Chain(span=bare.span(1), text=bare[1]), "done", bare.end(1)
                elif bare:
                    passed = bare.end(1)  # the same run does not end its line from a later start either
            last = None
        elif kind == "plus":
            mode = "value" if target is not None else mode
        elif kind == "name":
            if target is not None and mode == "value" and m[0] in held:
                chain = held[m[0]] if chain is None else Chain((chain, held[m[0]]))
            last = m[0]
        else:
            last = None
    if target is not None and chain is not None:
        yield target, chain


def named_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target and content score as a secret together."""
    low = text.lower()
    if not any(s in low for s in _STEMS) or not any(c in text for c in "=:>"):
        return []
    found = []
    for name, chain in pairs(text):
        if weight := sensitivity(name):
            strength = chain.strength()
            if weight + strength >= THRESHOLD + 0.5 and strength >= 0.5:
                found += chain.spans()
    return sorted(set(found))


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    out.sort(key=lambda s: s[1])
    starts, reach = [s for _, s, _ in out], [0, *accumulate((e for _, _, e in out), max)]
    out += [("literal", a, b) for a, b in named_literals(text) if reach[bisect_right(starts, a)] < b]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Runs of HEX are maximal, so those that are long enough can be sought directly.
_LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_LENGTH},}}")
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end)."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the base spans' digest and all spans as one string."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), number("literal"))


def cut_out(text: str) -> str:
    """The text with each secret replaced by its kind in brackets; names before a value stay."""
    out, at = [], 0
    for kind, start, end in spans_of(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if end > at:
            out += [text[at:max(start, at)], f"[{kind}]" if start >= at else ""]
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets cut out; a column `n_chars` follows the text. All rows and columns stay."""
    place = {f.name: i for i, f in enumerate(docs.schema)}

    def run(batches):
        for b in batches:
            old = b.column(place["text"]).to_pylist()
            new = [cut_out(t) if t else t for t in old]
            changed = [i for i, (x, y) in enumerate(zip(old, new)) if x != y]
            if changed:
                b = b.set_column(place["text"], b.schema.field(place["text"]), pa.array(new, b.schema.field(place["text"]).type))
                if "n_chars" in place:
                    kind = b.schema.field(place["n_chars"])
                    sizes = b.column(place["n_chars"]).to_pylist()
                    for i in changed:
                        sizes[i] = len(new[i])
                    b = b.set_column(place["n_chars"], kind, pa.array(sizes, kind.type))
            yield b

    return docs.mapInArrow(run, docs.schema)
