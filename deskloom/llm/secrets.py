"""Secrets in texts: fixed patterns, and literals assigned to names that tell of a secret.

The fixed patterns give the base spans. Beside them a lexer reads source and configuration syntax
(assignments, mappings, subscripts, set-calls, tags, options) into name-literal pairs. A name that
is assigned a literal is a constant; a later use of the name, also joined with others, carries the
literal along. A literal is reported where the product of what its target name tells and of how
much the literal looks like a secret reaches ``THRESHOLD``, unless a base span holds it already.

Spans are code points, end exclusive. Null text: empty, no spans. Ids may be null or repeat; each
row is searched on its own. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from deskloom.llm.common import pick

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "literal")
_TELLING = r"(?:pass|pwd|secret|token|key|cred|auth|bearer|signature|salt)"
#: What tells that a text can have a span at all, for a linear scan of whole Arrow columns. It takes in
#: every form of the lexer: an option with a telling name, such a name before an operator or the end of
#: a tag, and a string that holds one before an operator, a subscript's end or a comma.
HINT = (
    rf"(?i)(?:AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}|--[\w$.\-]*{_TELLING}|{_TELLING}[\w$.\-]*[\s\x0b]*[:=>]"
    rf"|{_TELLING}[^\n]*[\"'`][\s\x0b]*\]?[\s\x0b]*[:=,])"
)

THRESHOLD = 0.5
#: How strongly a part of a name tells of a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "pass": 0.7, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8,
    "signature": 0.6, "salt": 0.6, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0,
}
#: Parts that tell of a secret only before "key".
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "client", "auth"}
#: Parts that make a name speak about a secret instead of holding it.
ABOUT = {
    "count", "length", "len", "size", "name", "url", "uri", "path", "file", "type", "field", "label", "hint", "min",
    "max", "limit", "expiry", "expires", "ttl", "policy", "regex", "pattern", "prompt", "input", "reset", "index",
}
PLACEHOLDERS = {
    "changeme", "password", "secret", "token", "example", "placeholder", "undefined", "null", "none", "true", "false",
    "test", "xxx", "xxxx", "todo", "redacted", "string", "required", "optional",
}

_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
    r"""|(?P<name>-{0,2}[A-Za-z_$][\w$]*+(?:[.\-](?=[\w$])[\w$]+)*+)"""
    r"""|(?P<number>[0-9][\w.]*+)|(?P<op>=>|:=|==|!=|<=|>=|[=:])|(?P<mark>[^\s\w])|(?P<line>\n)""",
    re.ASCII,
)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, leftmost and without overlap for each kind, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def name_score(name: str) -> float:
    """How strongly a target name tells of a secret, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in ABOUT:
        return 0.0
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(b == "key" and a in KEY_OF for a, b in zip(parts, parts[1:])):
        best = 1.0
    return best


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, variety and kinds of characters."""
    bare = value.strip()
    if len(bare) < 6 or any(c.isspace() for c in bare) or bare.lower().strip("*<>{}$%") in PLACEHOLDERS:
        return 0.0
    if bare.startswith(("${", "<", "{{", "%(", "http://", "https://", "/")) or len(set(bare)) < 4:
        return 0.0
    counts = Counter(bare)
    bits = -sum(n / len(bare) * math.log2(n / len(bare)) for n in counts.values())
    kinds = sum(any(test(c) for c in bare) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 3.5) * min(1.0, len(bare) / 8) * (0.5 if kinds == 1 else 1.0)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Name, literal and span of each literal that reaches the name, constants propagated."""
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    constants: dict[str, list[tuple[str, int, int]]] = {}
    n, i = len(tokens), 0

    def literal(token) -> tuple[str, int, int]:
        _, raw, a, b = token
        return raw[1:-1], a + 1, b - 1

    def value_at(at: int, bare: bool) -> tuple[list[tuple[str, int, int]], int]:
        """Literals of the expression that starts at a token, and the token after it."""
        out: dict[tuple[str, int, int], None] = {}  # each literal once, however often it is joined
        first, joined = at, True
        while at < n and joined:
            kind, raw, a, b = tokens[at]
            if kind == "string":
                out[literal(tokens[at])] = None
            elif kind == "name" and raw in constants and not (at + 1 < n and tokens[at + 1][1] in "([" ):
                out.update(dict.fromkeys(constants[raw]))
            elif bare and at == first and kind in ("name", "number", "mark") and (m := _BARE.match(text, a)):
                word = m.group().rstrip(":.!?")
                if word and not word.isalpha():
                    out[word, a, a + len(word)] = None
                while at + 1 < n and tokens[at + 1][2] < m.end():
                    at += 1
            else:
                break
            at += 1
            joined = at < n and tokens[at][1] in ("+", ".", "&") and at + 1 < n
            at += joined
        return list(out), at

    while i < n:
        kind, raw, a, b = tokens[i]
        name = None
        if kind in ("name", "string") and i + 1 < n:
            key = raw if kind == "name" else raw[1:-1]
            j = i + 1
            if tokens[j][1] == "]" and kind == "string":  # subscript
                j += 1
            if j + 1 < n and tokens[j][1] in ("=", ":", ":=", "=>"):
                name, start, bare = key, j + 1, kind == "name" or tokens[j][1] == ":"
            elif kind == "string" and j + 1 < n and tokens[j][1] == "," and tokens[j + 1][0] == "string":
                name, start, bare = key, j + 1, False  # set("name", "value")
            elif kind == "name" and raw.startswith("--") and tokens[j][0] in ("string", "name", "number"):
                name, start, bare = key, j, True  # --name value
            elif kind == "name" and tokens[j][1] == ">" and i and tokens[i - 1][1] == "<" and j + 1 < n:
                name, start, bare = key, j + 1, True  # <name>value</name>
        if name is None:
            i += 1
            continue
        found, after = value_at(start, bare)
        constants[name] = found
        for value, x, y in found:
            yield name, value, x, y
        i = max(after - 1, i + 1) if found else i + 1


def literal_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    taken = np.array([(a, b) for _, a, b in base]).reshape(-1, 2)
    out = set()
    for name, value, a, b in pairs(text):
        if (told := name_score(name)) and told * literal_score(value) >= THRESHOLD:
            if not ((taken[:, 0] < b) & (taken[:, 1] > a)).any():
                out.add(("literal", a, b))
    return sorted(out, key=lambda s: s[1:])


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and method spans together."""
    base = base_spans(text)
    added = literal_spans(text, base)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = batch.column("text")
        n = len(texts)
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        digests, spans = [nothing] * n, [""] * n
        for row in np.flatnonzero(pc.match_substring_regex(texts, HINT).fill_null(False).to_numpy(False)).tolist():
            base, every = all_spans(texts[row].as_py())
            for kind, *_ in every:
                counts[kind][row] += 1
            digests[row] = hashlib.sha256(joined(base).encode()).hexdigest()
            spans[row] = joined(every)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id")} | {f"n_{k}": pa.array(counts[k]) for k in KINDS[:3]}
            | {"base_sha256": pa.array(digests), "spans": pa.array(spans), "n_literal": pa.array(counts["literal"])}
        )


def secret_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal for each row."""
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(
        _search,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long",
    )


def mask(docs: DataFrame, *, text: str = "text", by: str = "*") -> DataFrame:
    """The same rows and columns with every code point of a secret replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at)
            hints = np.flatnonzero(pc.match_substring_regex(texts, HINT).fill_null(False).to_numpy(False)).tolist()
            if hints:
                values = texts.to_pylist()
                for row in hints:
                    for _, a, b in all_spans(values[row])[1]:
                        values[row] = values[row][:a] + by * (b - a) + values[row][b:]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, texts.type))
            yield batch

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, docs.schema)
