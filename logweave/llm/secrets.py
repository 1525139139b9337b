"""Problem 3: credentials in code, configuration and command output, found and redacted.

One pass over the lines gives the layout of a text: which keys its braces, YAML indentation and
INI or TOML sections put around each byte.  A scanner reads the members of the configuration and
command formats a text may hold (assignments, JSON and YAML members with folded and literal
values, XML attributes and elements, name and value pairs, headers, URLs, netrc lines, command
options) as key paths with the byte offsets of their values.  A value is a secret if a name on its
path is sensitive and its shape is that of a password or a token (below a sensitive parent, plain
leaves such as ``type`` or ``host`` excepted), or if its shape alone gives it away.  Redactions are
spliced into the original bytes, so everything else stays as it was.

Every scan takes time in proportion to the text; words, lines and values may have any length.

Defined results: null and empty texts hold nothing (and stay as they are); a placeholder, masked
value or reference is no secret, nor is a word of letters alone, quoted or not; overlapping
findings count once, from the first byte on; a text of any length is read whole; repeated rows are
answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names under which secrets are kept.  PASS names take passwords, TOKEN names take
# random tokens, WEAK names take only values whose shape alone is nearly enough.
PASS_NAMES = ("password", "passwd", "passphrase", "passwort", "kennwort", "contrasena", "contraseña", "clave", "passe", "storepass", "keypass", "pass", "pwd", "pw", "secret", "smtppass")
TOKEN_NAMES = ("token", "apikey", "secretkey", "accesskey", "accountkey", "authkey", "signingkey", "encryptionkey", "privatekey", "masterkey", "sessionkey", "auth", "xauth", "authorization", "basic", "bearer", "sig", "signature", "credential", "credentials", "jwt")
WEAK_NAMES = ("key", "k", "sid", "session", "value", "default")
# What stands for a secret without being one.
PLACEHOLDERS = frozenset("null none nil undefined true false changeme change_me placeholder redacted example dummy secret password token todo tbd unset empty default string hidden masked".split())
# Words of a message about a value rather than of a value.
MESSAGE_WORDS = frozenset("must should required enter your invalid least most the is are an not be has have please wrong missing too than characters chars long length see from with".split())
#: Leaves that describe a secret instead of holding it.
DESCRIBES = frozenset("name type kind id user username login email host hostname server port url uri path file filename version region zone env environment description comment label algorithm alg hash created updated expires expiry date time issuer audience scope scopes role policy length size min max regex pattern format provider engine image schema ref arn title message hint source target".split())

# A key starts only where no word goes on, and its parts are never given back: so each byte is read once.
_KEY = rb"(?<![\w\x80-\xff.])(?<![\w\x80-\xff]-)(?P<key>[A-Za-z_\xc2-\xf4][\w\x80-\xff]*+(?:[.-]+[\w\x80-\xff]++)*+)"
_BARE = rb"[^\s\"'`,;)}\]<>&\\]++"
_VALUE = rb"(?:(?P<q>\\?[\"']{1,3}|`)(?P<qv>(?:(?!(?P=q)).)*?)(?P=q)|q[qwx]?\((?P<pv>[^)]*)\)|(?P<bv>" + _BARE + rb"))"
_SCHEME = rb"(?:(?:Bearer|Basic|Token|Digest|ApiKey)\s+)?"
ASSIGN = re.compile(_KEY + rb"(?:\\?[\"']\s*\]?|\])?\s*(?:\|\|=|:=|=>|=(?!=)|:(?![/:=])|,(?=\s*\\?[\"']))\s*(?P<block>[|>][+-]?\d?[ \t]*\r?\n)?" + _SCHEME + _VALUE, re.S)
# A name, white space, a value: Dockerfile ENV, setx, set-option, netrc.
SPACED = re.compile(rb"(?:\b(?:ENV|ARG|setx|setenv|SET|set|set-option|set-secret)\s+(?:-\w+\s+)*(?P<key>[A-Za-z_][\w.-]*)|\blogin\s+\S+\s+(?P<netrc>password|passwd))\s+(?P<bv>" + _BARE + rb")")
PROSE = re.compile(
    rb"(?i:(?:\b(?:passwor[dt]|kennwort|passwd|passphrase|clave|contrase\xc3\xb1a|mot de passe|pw)\b\s*(?:\b(?:ist|is|es|est|was)\b\s*[:=]?|[=:])|\bpw\b)\s+)[\"']?(?P<bv>[^\s\"'`,;)}\]<>]++)"
)
# Words after which a value of the right shape, a few words on, is taken for a secret: for a password, or for a token.
ANNOUNCE = re.compile(
    rb"(?i)\b(?:(?P<pass>passwor[dt]s?|passphrase|kennwort|contrase\xc3\xb1a|credentials?|log(?:ged)?[ -]?in|logon|sign(?:ed)?[ -]in|unlock(?:ed|s)?|unset)"
    rb"|(?:old|new|api|access) key|print(?:ed|s)?|echo(?:ed|es)?|shows?|showed|leak(?:ed|s)?|expos(?:ed|es)|pasted?|typed?|entered)\b"
)
WORD = re.compile(rb"[^\s\"'`,;)}\]<>]++")
OPTION = re.compile(rb"(?:^|\s)--?(?P<key>[A-Za-z][\w-]*+)[ =]\s*[\"']?(?P<bv>" + _BARE + rb")")
COMMAND = re.compile(rb"[^|;\n]++")
TOOL = re.compile(rb"\b(?:(?P<short>sshpass|mysql|mysqldump|mariadb|docker login|podman login|redis-cli|ldapsearch)|(?P<user>curl|wget|http|https))\b(?!:)")
SHORT_P = re.compile(rb"\s-(?:p|a|w)\s?[\"']?(?P<bv>" + _BARE + rb")")
USERPASS = re.compile(rb"\s(?:-u|--user)[ =]?[\"']?[\w.@-]++:(?P<bv>" + _BARE + rb")")
USERINFO = re.compile(rb"://[^\s/:@\"'<>]*:(?P<bv>[^\s/\"'<>]+?)@(?=[\w.\[-])")
QUERY = re.compile(rb"[?&;](?P<key>[\w.-]++)=(?P<bv>[^&\s\"'<>#]++)")
XML_TAG = re.compile(rb"<\w[^<>]*+>")
XML_ATTR = re.compile(rb"\b(?P<name>key|name|value)\s*=\s*[\"'](?P<bv>[^\"']*+)[\"']", re.I)
XML_ELEMENT = re.compile(rb"<(?P<key>[\w.:-]++)>(?P<bv>[^<>\s]++)</(?P=key)>")
BRACE = re.compile(rb"[{}]")
LINE_KEY = re.compile(rb"(?P<indent>[ \t]*+(?:- +)?)[\"']?(?P<key>[A-Za-z_][\w.-]*+)[\"']?:(?P<rest>[ \t]*+(?:#[^\n]*)?\r?\n)?")
SECTION = re.compile(rb"[ \t]*+\[{1,2}[ \t]*(?P<key>[A-Za-z_][\w.\" -]*?)[ \t]*\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?(?:\n|\Z)")
SECTION_LINE = re.compile(rb"[ \t]*+(?:[#;][^\n]*|[\w.\"'-]++[ \t]*[=:][^\n]*)?\r?(?:\n|\Z)")
_NAME_OF = rb"[\"']?\b(?:name|key)\b[\"']?\s*[:=]\s*[\"']?(?P<key>[A-Za-z_][\w.-]*+)[\"']?"
_VALUE_OF = rb"[\"']?\bvalue\b[\"']?\s*[:=]\s*" + _VALUE
NAMED_VALUES = (re.compile(_NAME_OF + rb"\s*[,;]?\s*" + _VALUE_OF, re.S), re.compile(_VALUE_OF + rb"\s*[,;]?\s*" + _NAME_OF, re.S))
PRIVATE = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
# Never secret, whatever is in them: public keys, checksums, embedded data.
PUBLIC = re.compile(
    rb"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST)-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)"
    rb"|\bdata:[\w.+/-]++;base64,[\w+/=-]++|\bsha(?:1|224|256|384|512)[-:=][\w+/=-]++|\bmd5[-:=]\w++"
    rb"|\bssh-(?:ed25519|rsa|dss)\s+[\w+/=]++|\becdsa-sha2-\S++\s+[\w+/=]++"
    rb"|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
    rb"|\b(?:commit|etag|traceparent:?|revision|digest|checksum|fingerprint)\b[\s:=]*+\"?[0-9a-f-]{16,}+\"?"
    rb"|[\"']?integrity[\"']?\s*[:=]\s*[\"'][^\"']*[\"']",
    re.S | re.I,
)
JWT = re.compile(rb"(?<![\w-])eyJ[\w-]{10,}+={0,2}\.[\w-]{6,}+={0,2}\.[\w-]{6,}+")
# A short tag, a separator, then a long random part; groups of them; or the fixed-length upper-case form.
TAGGED = re.compile(rb"(?<![\w/+.-])(?:[a-z]{2,6}[-_](?:(?:live|test|prod|pat|[0-9]{6,})[-_])?[A-Za-z0-9]{20,}+|[a-z]{3,6}(?:-[A-Za-z0-9]{8,}+){2,}+|[A-Z]{1,4}[0-9]?\.[\w-]{16,}+\.[\w-]{24,}+|[A-Z]{4}[A-Z0-9]{16}(?![A-Z0-9]))(?![.-]*+[\w/+=])")
RANDOM = re.compile(rb"(?<![\w/+=.-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![\w/+=-])")


def entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def is_reference(v: bytes) -> bool:
    """A variable, an environment lookup, a template, a call or an attribute instead of a value."""
    return bool(
        re.match(rb"\$|%\w+%|\{\{|\{[\w.]*\}|<[^>]*>?$|@\w+\(|(?:os|process|sys|env|ENV|config|secrets?|vault|form|settings|getpass|System|Deno)[.\[(]", v)
        or re.match(rb"[A-Za-z_][\w.]*\(", v)
        or re.fullmatch(rb"(?:[a-z_]+\.)+[A-Za-z_]+", v) and not re.search(rb"\d", v)
    )


def is_placeholder(v: bytes) -> bool:
    low = v.lower()
    return (
        not v
        or low.decode("utf-8", "replace") in PLACEHOLDERS
        or bool(re.fullmatch(rb"(?:[*xX.\xe2\x80\xa2#-]|\\\*)+", v))
        or bool(re.search(rb"\*{3,}|x{4,}|\.\.\.|your[-_ ]|[-_]here\b|changeme|placeholder|redacted|example[-_]", low))
    )


def is_password(v: bytes) -> bool:
    return len(v) >= 6 and bool(re.search(rb"[A-Za-z]", v)) and bool(re.search(rb"\d", v) or re.search(rb"[#!$%^*?~]", v) or (re.search(rb"[a-z][A-Z]", v) and len(v) >= 10)) and not re.fullmatch(rb"[a-z0-9.-]+:\d+|v?\d+(?:\.\d+)*", v)


def is_passphrase(v: bytes) -> bool:
    """A quoted value of a few words with a digit or a sign, that is no sentence about a password."""
    words = v.split()
    return 2 <= len(words) <= 8 and len(v) >= 10 and bool(re.search(rb"[\d#!$%^*?~]", v)) and not any(w.lower().strip(b".,:!?").decode("utf-8", "replace") in MESSAGE_WORDS for w in words)


def is_token(v: bytes) -> bool:
    if JWT.fullmatch(v) or TAGGED.fullmatch(v):
        return True
    if len(v) < 16 or not re.fullmatch(rb"[\w+/=.~-]+", v):
        return False
    mixed = bool(re.search(rb"\d", v)) + bool(re.search(rb"[a-z]", v)) + bool(re.search(rb"[A-Z]", v))
    return (mixed >= 2 and entropy(v) >= 3.0) if re.search(rb"\d", v) else mixed == 2 and len(v) >= 20 and entropy(v) >= 3.8


def is_strong(v: bytes) -> bool:
    """Shaped like a secret even under a plain name."""
    if JWT.fullmatch(v) or TAGGED.fullmatch(v):
        return bool(re.search(rb"\d", v)) or bool(re.search(rb"[a-z][A-Z]|[A-Z][a-z]", v))
    if re.fullmatch(rb"[0-9a-f]{32,}", v):
        return True
    classes = bool(re.search(rb"\d", v)) + bool(re.search(rb"[a-z]", v)) + bool(re.search(rb"[A-Z]", v))
    return len(v) >= 24 and classes == 3 and entropy(v) >= 4.0 and bool(re.fullmatch(rb"[\w+/=-]+", v))


def is_typed(v: bytes) -> bool:
    """Shaped like a password that someone chose or a machine made, and like nothing else one writes in prose."""
    if len(v) < 8 or is_placeholder(v) or is_reference(v) or re.search(rb"[(\[{=/\\|@:]|\.\w", v):
        return False
    digit, lower, upper, sign = (bool(re.search(p, v)) for p in (rb"\d", rb"[a-z]", rb"[A-Z]", rb"[#!$%^*?~&+]"))
    if not digit or not (lower or upper):
        return False
    if sign and len(v) >= 8:
        return lower
    return lower and upper and len(v) >= 10 and entropy(v) >= 2.8 and len(re.findall(rb"(?<=[a-zA-Z])\d|(?<=\d)[a-zA-Z]|(?<=[a-z])[A-Z]", v)) >= 3


def is_chosen(v: bytes) -> bool:
    """A word or words with digits at the end, as people choose passwords."""
    return len(v) >= 8 and bool(re.fullmatch(rb"[A-Za-z]{3,}+(?:[._!-][A-Za-z]{3,}+)*+[._!-]?\d{2,}+[!?#$*]?", v)) and not is_placeholder(v)


_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\x80-\uffff]+|\d+")


def name_class(key: str) -> str:
    """pass, token, weak or '' by the last words of a key."""
    words = [w.lower() for w in _CAMEL.findall(key)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return ""
    ends = {words[-1], "".join(words[-2:])}
    joined = "".join(words)
    if ends & set(PASS_NAMES) or words[-1].endswith(("password", "passwd", "storepass")) or joined.endswith("pgpassword"):
        return "pass"
    if ends & set(TOKEN_NAMES) or words[-1].endswith("token"):
        return "token"
    return "weak" if words[-1] in WEAK_NAMES else ""


def parent_class(parents: list[str]) -> str:
    """pass, token or '' by the nearest sensitive parent, plural or not."""
    for parent in reversed(parents):
        if (kind := name_class(parent)) in ("pass", "token") or (kind := name_class(parent.removesuffix("s"))) in ("pass", "token"):
            return kind
    return ""


class Node:
    """A key that encloses a stretch of text; its parents are found through ``up``."""

    __slots__ = ("kind", "names", "up")

    def __init__(self, names: list[str], up: Node | None):
        self.names, self.up = names, up
        own = parent_class(names)
        self.kind = own or (up.kind if up else "")

    def path(self) -> list[str]:
        parts, node = [], self
        while node:
            parts.append(node.names)
            node = node.up
        return [n for names in reversed(parts) for n in names]


def _names(*parts: bytes | None) -> list[str]:
    return [w for p in parts if p for w in p.decode("utf-8", "replace").replace('"', "").split(".") if w]


def _block_name(data: bytes, low: int, high: int) -> list[str]:
    """Names right before an opening brace, looked for no further back than ``low``."""
    end = high
    while end > low and data[end - 1] in b" \t\r\n":
        end -= 1
    if end > low and data[end - 1] in b":=":
        end -= 1
        while end > low and data[end - 1] in b" \t\r\n":
            end -= 1

    def word(end: int) -> tuple[int, bytes]:
        quoted = end > low and data[end - 1] in b"\"'"
        at = end = end - 1 if quoted else end
        while at > low and (data[at - 1] in b"_.-" or chr(data[at - 1]).isalnum()):
            at -= 1
        return at - (1 if quoted and at > low and data[at - 1] in b"\"'" else 0), data[at:end].rstrip(b"\\")

    at, last = word(end)
    if end > low and data[end - 1] in b'"' and at > low and data[at - 1] in b" \t":
        # A label after the kind of block: kind "label" {
        end = at
        while end > low and data[end - 1] in b" \t":
            end -= 1
        _, first = word(end)
        return _names(first, last)
    return _names(last) if last[:1].isalpha() or last[:1] == b"_" else []


class Layout:
    """Which keys enclose each byte: by braces, by indentation and by sections; built in one pass each."""

    def __init__(self, data: bytes):
        self.marks: list[tuple[list[int], list[Node | None]]] = []
        if b"{" in data:
            at, nodes = [0], [None]
            opened: list[Node | None] = []
            node, low = None, 0
            for m in BRACE.finditer(data):
                if m.group() == b"{":
                    opened.append(node)
                    names = _block_name(data, low, m.start())
                    node = Node(names, node) if names else node
                else:
                    node = opened.pop() if opened else None
                at.append(m.end())
                nodes.append(node)
                low = m.end()
            self.marks.append((at, nodes))
        if b"\n" not in data:
            return
        at, nodes = [0], [None]
        sections, section_nodes, in_section = [0], [None], False
        stack: list[tuple[int, Node]] = []
        first, size = 0, len(data)
        while first < size:
            end = data.find(b"\n", first) + 1 or size
            if data[first:end].isspace():
                first = end
                continue
            key = LINE_KEY.match(data, first, end)
            depth = first
            while depth < end and data[depth] in b" \t":
                depth += 1
            dash, depth = data[depth : depth + 2] == b"- ", depth - first
            while stack and (stack[-1][0] > depth or stack[-1][0] == depth and not (dash and not key)):
                stack.pop()
            if key and key.group("rest") is not None:
                stack.append((len(key.group("indent")), Node(_names(key.group("key")), stack[-1][1] if stack else None)))
            if (stack[-1][1] if stack else None) is not nodes[-1]:
                at.append(end if key and key.group("rest") is not None else first)
                nodes.append(stack[-1][1] if stack else None)
            if section := SECTION.match(data, first, end):
                sections.append(end)
                section_nodes.append(Node(_names(section.group("key")), None))
                in_section = True
            elif in_section and not SECTION_LINE.match(data, first, end):
                sections.append(first)
                section_nodes.append(None)
                in_section = False
            first = end
        if len(at) > 1:
            self.marks.insert(0, (at, nodes))
        if len(sections) > 1:
            self.marks.insert(0, (sections, section_nodes))

    def nodes(self, at: int) -> list[Node]:
        return [n for starts, nodes in self.marks if (n := nodes[bisect_right(starts, at) - 1])]

    def kind(self, at: int) -> str:
        """Class of the nearest sensitive parent."""
        return next((n.kind for n in reversed(self.nodes(at)) if n.kind), "")

    def path(self, at: int) -> list[str]:
        return [name for n in self.nodes(at) for name in n.path()]


class Closed:
    """Stretches that hold no finding; asked in order or not, each question by search."""

    def __init__(self, spans: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.starts, self.ends = [a for a, _ in merged], [b for _, b in merged]

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, b - 1) - 1
        return i >= 0 and self.ends[i] > a


@dataclass(frozen=True)
class Finding:
    start: int  # byte offsets
    end: int
    path: str


def _accept(kind: str, v: bytes, loose: bool = False) -> bool:
    if is_placeholder(v) or is_reference(v):
        return False
    if kind == "pass":
        return is_password(v) or is_token(v)
    if kind == "token":
        return is_token(v) or (loose and len(v) >= 8)
    return kind == "weak" and is_strong(v)


def _span(m: re.Match) -> tuple[int, int, bool]:
    """Span of the value of a match; whether it stood in quotes."""
    for name in ("qv", "pv", "bv"):
        if name in m.re.groupindex and m.group(name) is not None:
            return m.start(name), m.end(name), name == "qv"
    return m.end(), m.end(), False


def _folded(data: bytes, at: int) -> tuple[int, int]:
    """Span of the indented lines from ``at`` on: a YAML block value."""
    first = None
    end, depth = at, -1
    while at < len(data):
        stop = data.find(b"\n", at) + 1 or len(data)
        line = data[at:stop]
        body = line.lstrip(b" \t")
        if body.strip():
            here = len(line) - len(body)
            if depth < 0:
                if not here:
                    break
                depth, first = here, at + here
            elif here < depth:
                break
            end = at + len(line.rstrip())
        at = stop
    return (first, end) if first is not None else (at, at)


def find(data: bytes) -> list[Finding]:
    """All secrets of a text in UTF-8, in order and without overlap."""
    found: list[Finding] = [Finding(m.start(), m.end(), "private_key") for m in PRIVATE.finditer(data)]
    closed = Closed([m.span() for m in PUBLIC.finditer(data)] + [(f.start, f.end) for f in found])
    layout = Layout(data)

    def add(a: int, b: int, path: str) -> None:
        if a < b and not closed.meets(a, b):
            found.append(Finding(a, b, path))

    def path_of(key: str, at: int) -> str:
        return ".".join([*layout.path(at), key])

    def kind_at(key: str, at: int) -> str:
        """The class of a path: of its leaf, else of its parents."""
        kind = name_class(key)
        if kind in ("", "weak") and layout.marks and key.lower().replace("_", "").replace("-", "") not in DESCRIBES:
            return layout.kind(at) or kind
        return kind

    at = 0
    while m := ASSIGN.search(data, at):
        at = m.start("key") + max(1, len(m.group("key")))
        a, b, quoted = _span(m)
        key = m.group("key").decode("utf-8", "replace")
        kind = kind_at(key, a)
        if not kind:
            continue
        if m.group("block"):
            a, b = _folded(data, m.end("block"))
            value = b"".join(data[a:b].split())
            if value and _accept(kind, value):
                add(a, b, path_of(key, m.start("key")))
                at = max(at, b)
            continue
        value = data[a:b]
        scheme = re.match(rb"(?:Bearer|Basic|Token|Digest)\s+", value)
        if scheme:
            a += scheme.end()
            value = data[a:b]
        if not quoted and m.group("bv") is not None:
            value = value.rstrip(b".")
            b = a + len(value)
        named = bool(scheme) or bool(re.search(rb"(?:Bearer|Basic|Token|Digest)\s+$", data[max(m.start(), a - 12) : a]))
        if b" " in value and not named:
            if quoted and kind == "pass" and name_class(key) == "pass" and not is_placeholder(value) and not is_reference(value) and is_passphrase(value):
                add(a, b, path_of(key, m.start("key")))
                at = max(at, b)
            continue
        if not quoted and data[b : b + 1] == b"(":
            continue
        if _accept(kind, value, loose=named):
            add(a, b, path_of(key, m.start("key")))
            at = max(at, b)
    if b"value" in data:
        for pattern in NAMED_VALUES:
            for m in pattern.finditer(data):
                key = m.group("key").decode("utf-8", "replace")
                kind = name_class(key)
                a, b, _ = _span(m)
                if kind and b" " not in data[a:b] and _accept(kind, data[a:b]):
                    add(a, b, path_of(key, a))
    if b"<" in data:
        for tag in XML_TAG.finditer(data):
            key, value = "", None
            for m in XML_ATTR.finditer(data, tag.start(), tag.end()):
                if m.group("name").lower() == b"value":
                    value = m
                elif not key:
                    key = m.group("bv").decode("utf-8", "replace")
            if key and value and (kind := name_class(key)) and _accept(kind, value.group("bv")):
                add(*value.span("bv"), path_of(key, value.start("bv")))
    for pattern, sign in ((XML_ELEMENT, b"</"), (QUERY, b"="), (SPACED, b""), (OPTION, b"-")):
        if sign not in data:
            continue
        for m in pattern.finditer(data):
            key = (m.group("key") or m.group("netrc")).decode("utf-8", "replace") if pattern is SPACED else m.group("key").decode("utf-8", "replace")
            kind = name_class(key)
            a, b, _ = _span(m)
            if kind and _accept(kind, data[a:b]):
                add(a, b, path_of(key, a))
    if b"://" in data:
        for m in USERINFO.finditer(data):
            if data[max(0, m.start() - 1) : m.start()].isalnum() and not is_placeholder(m.group("bv")) and not is_reference(m.group("bv")):
                add(*m.span("bv"), "url.password")
    if TOOL.search(data):
        for command in COMMAND.finditer(data):
            tools = {"short" if m.group("short") else "user": m.end() for m in reversed(list(TOOL.finditer(data, *command.span())))}
            for name, pattern, path in (("short", SHORT_P, "option.password"), ("user", USERPASS, "user.password")):
                for m in pattern.finditer(data, tools[name], command.end()) if name in tools else ():
                    value = m.group("bv")
                    if not is_placeholder(value) and not is_reference(value) and (name == "user" or is_password(value)):
                        add(*m.span("bv"), path)
    for m in PROSE.finditer(data):
        value = m.group("bv").rstrip(b".")
        if is_password(value) and re.search(rb"\d|[$#!]", value) and not re.search(rb"[(\[{=]|://|@.*:", value) and not is_placeholder(value) and not is_reference(value):
            add(m.start("bv"), m.start("bv") + len(value), "prose")
    for m in ANNOUNCE.finditer(data):
        at, end = m.end(), data.find(b"\n", m.end())
        for _ in range(4):
            word = WORD.search(data, at, end if end >= 0 else len(data))
            if not word:
                break
            value = word.group().rstrip(b".:")
            if is_typed(value) or (bool(m.group("pass")) and is_chosen(value)) or (len(value) >= 20 and not m.group("pass") and _accept("token", value) and b"/" not in value):
                add(word.start(), word.start() + len(value), "prose")
                break
            at = word.end()
            if data[word.end() - 1 : word.end()] == b"." or data[word.end() : word.end() + 1] == b";":
                break
    for pattern in (JWT, TAGGED, RANDOM):
        for m in pattern.finditer(data):
            v = m.group()
            if pattern is RANDOM and (re.fullmatch(rb"[0-9a-fA-F-]+", v) or v.count(b"/") * 20 > max(120, len(v)) or not is_strong(v)):
                continue
            if pattern is TAGGED and not (re.search(rb"\d", v) and is_strong(v)):
                continue
            add(m.start(), m.end(), "shape")
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def redact(data: bytes, found: list[Finding], mark: bytes = b"<secret>") -> bytes:
    parts, at = [], 0
    for f in found:
        parts += [data[at : f.start], mark]
        at = f.end
    return b"".join([*parts, data[at:]])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
        if text:
            yield i, text


def find_secrets(df: DataFrame, id_col: str = "sid", text_col: str = "search_text") -> DataFrame:
    """One row per secret value: ``id_col``, ``start_pos`` (characters), ``byte_start``, ``byte_end``, ``key_path``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, start, end, path = [], [], [], [], []
            for i, data in _texts(batch):
                seen, chars = 0, 0
                for f in find(data):
                    row.append(i)
                    chars += len(data[seen : f.start].decode("utf-8", "replace"))
                    seen = f.start
                    pos.append(chars)
                    start.append(f.start)
                    end.append(f.end)
                    path.append(f.path)
            ids = batch.column(0).take(pa.array(np.array(row, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(path, pa.string())], names=[id_col, "start_pos", "byte_start", "byte_end", "key_path"])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, start_pos bigint, byte_start bigint, byte_end bigint, key_path string")


def redact_secrets(df: DataFrame, id_col: str = "sid", text_col: str = "search_text") -> DataFrame:
    """``id_col`` and ``text_col`` with every secret value replaced; null stays null."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            out = [t if not t else redact(t, find(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=[id_col, text_col])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, `{text_col}` string")
