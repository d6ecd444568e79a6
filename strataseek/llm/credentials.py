"""Problem 2: credentials in code, scripts, notes and settings.

One deterministic automaton over bytes holds the beginnings of token formats, key armour,
connection strings, assignments to names of secrets, flags, headers and statements. Its
accepting states are tagged with the grammar that they complete, and they accept where a
value begins. Contents are laid end to end and cut into overlapping windows that advance
through its table in step, one array operation for each position; where a window's state
behind the overlap isn't that of the window before, it goes on from the latter, so no match
depends on where windows lie; places found twice fall together. From each accepted
place one expression of its tag reads to the value's end, and the value is judged: a secret,
or a placeholder, plain word, name or reference. Nothing else of a text is looked at, but
for what continues at its head from above. Values are masked character by character, so
lines, offsets and quotes stay what they were.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from re import _constants as rc
from re import _parser as rp

from strataseek.functions.runtime import cut, table

WINDOW = 1536
OVERLAP = 512

# Beginnings of issued tokens, and what follows them.
TOKENS = [
    (r"A[KS]IA", r"[0-9A-Z]{16}"), (r"AIza", r"[\w-]{30,}"), (r"gh[pousr]_", r"\w{20,}"), (r"github_pat_", r"\w{20,}"), (r"glp[at]t-", r"[\w-]{16,}"), (r"gldt-", r"[\w-]{16,}"),
    (r"xox[abeoprs]-", r"[\w-]{10,}"), (r"[rs]k_(?:live|prod|test)_", r"\w{12,}"), (r"SG\.", r"[\w-]{16,}\.[\w-]{16,}"), (r"eyJ", r"[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{10,}"),
    (r"npm_", r"[A-Za-z0-9]{30,}"), (r"hf_", r"[A-Za-z]{30,}"), (r"dop_v1_", r"[0-9a-f]{40,}"), (r"sk-", r"(?:ant-|proj-)?[A-Za-z0-9_-]{30,}"),
    (r"pypi-", r"[\w-]{30,}"), (r"shp(?:at|ca|pa|ss)_", r"[0-9a-fA-F]{32}"), (r"ya29\.", r"[\w-]{20,}"), (r"[a-z]{3,16}pat_", r"[0-9a-zA-Z]{20,}"),
]
TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(a + b for a, b in TOKENS) + ")")

# Name parts of secrets, those that need another part before them, and
# those after which the name means something about a secret instead.
SECRET_PARTS = set(
    "password passwords passwd passwort passphrase passcode pass pwd pw secret secrets token tokens apikey credential credentials cred creds bearer "
    "authorization salt pepper pin clave contrasena contraseña senha haslo hasło kennwort wachtwoord parol parola geheimnis hmac passe".split()
)
KEY_OWNERS = set("api access private signing master secret encryption auth shared account ssh service client deploy hmac session crypt aes rsa license storage".split())
ABOUT = set(
    "label field rule rules hint name names store header headers type id ids url uri path file dir length min max count policy expiry ttl placeholder title text "
    "message error column var env ref prefix suffix size index format regex pattern limit kind class help prompt description bucket schema table".split()
)
AFTER = set("seed pepper value b64 base64 hex enc encoded plain raw str string prod dev test live default old new backup key main primary secondary current".split())

PLACEHOLDER = re.compile(
    r"<[^>]*>|\*+|[xX]{4,}|[.\-_]+|0+|n/?a|tbd|none|null|nil|true|false|undefined|masked|hidden|secret|password|token|test(?:ing)?|foo(?:bar)?|bar|empty|redacted|placeholder"
    r"|(?:change|replace|your|insert|put|enter|set|see|add|use|my|fill)(?!\S*\d\d)(?:[-_ ].*|me|this|it|here)?|changeme\w*|your(?:key|token|password|secret)\w*"
    r"|(?:example|sample|dummy|fake|todo|fixme|redacted|placeholder)(?:[-_ ]?(?:key|token|password|passwd|pass|secret|value|only|here|cred\w*))*\d{0,3}",
    re.I | re.S,
)
REFERENCE = re.compile(
    r"^[$%@]?[{(]|^\$\w+$|^%\w+%$|\$\{|\{\{|%\(|#\{|process\.env|os\.environ|getenv|\bENV\b|env::|env\[|System\.get|secretsmanager|^vault:|^arn:|^ssm:|^op://|^(?:file|https?|env):|keychain|^[!&*]\w+$", re.I
)
WORDS = re.compile(r"[A-Za-z]+(?:[-_.:/][A-Za-z]+)*[?!.,:;]*")
NAME = re.compile(r"[a-z]+(?:[A-Z][a-z]*)*\d{0,4}|[A-Za-z][a-z]*(?:_[a-z]+|_\d+)*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z]+\d{0,3}|v?\d+(?:\.\d+)+\w*")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?(?:/\S*)?")
EMBEDDED = re.compile(r"^(?:sha\d+[-:]|data:|md5:|rev:|commit:)", re.I)
_PHRASE = re.compile(r"[A-Za-z]+(?:-[A-Za-z0-9]+){2,}")


def _flips(v: str) -> int:
    return sum(a.islower() != b.islower() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())


def secretish(v: str, named: bool) -> bool:
    """Whether a value is a secret. ``named``: it stands where only a secret can stand."""
    v = v.strip()
    if len(v) < 6 or any(c.isspace() for c in v) or PLACEHOLDER.fullmatch(v) or REFERENCE.search(v) or EMBEDDED.match(v):
        return False
    if TOKEN.match(v):
        return "EXAMPLE" not in v and len(set(v)) > 6
    if WORDS.fullmatch(v) and not (named and v[-1] == "!" and "_" in v and _flips(v)):
        return len(v) >= 16 and v.isalpha() and _flips(v) >= len(v) // 4
    if UUID.fullmatch(v) or not re.search("[A-Za-z]", v) or len(set(v)) < 5:
        return named and v.isdigit() is False and len(set(v)) >= 5 and not UUID.fullmatch(v) and bool(re.search(r"[^\w.,:/ -]", v))
    if NAME.fullmatch(v) and not (len(v) >= 16 and _flips(v) >= len(v) // 4):
        return False
    if v[0] in "./~" or HOST.fullmatch(v):
        return False
    digit, special = bool(re.search(r"\d", v)), bool(re.search(r"[^\w.,:/ -]", v))
    if named:
        return digit or special or _flips(v) >= 4
    return digit and (special or bool(_PHRASE.fullmatch(v)) or (len(v) >= 14 and _flips(v) >= 3))


#: Names written in one go, as SIGNINGKEY or accesstoken.
_RUN_TOGETHER = re.compile(r"\w*(?:password|passwd|passwort|passphrase|secret|token)|(?:\w*_)?(?:" + "|".join(sorted(KEY_OWNERS)) + r")key|\w*apikey|motdepasse")


def _parts(name: str) -> list[str]:
    name = unicodedata.normalize("NFC", name)
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "_" for c in name)
    return [name[m.start() : m.end()].lower() for m in re.finditer(r"A+(?!a)|A?a+", kinds)]


@lru_cache(100_000)
def names_secret(name: str) -> bool:
    """Whether a variable, field or setting of this name holds a secret."""
    parts = _parts(name)
    while parts and parts[-1] in AFTER - SECRET_PARTS and len(parts) > 1 and not (parts[-1] == "key" and parts[-2] in KEY_OWNERS):
        parts.pop()
    if not parts or parts[-1] in ABOUT:
        return False
    if parts[-1] in SECRET_PARTS:
        return True
    if parts[-1] in ("key", "keys") and len(parts) > 1 and parts[-2] in KEY_OWNERS:
        return True
    return bool(_RUN_TOGETHER.fullmatch(parts[-1]))


# the automaton

_STEMS = (
    "pass|pw|secret|token|key|cred|bearer|author|salt|pepper|pin|clave|contrase|senha|has(?:l|\xc5[\x81\x82])o|kennwo|wachtw|hmac|parol|geheim"
)
#: (tag, grammar, whether case matters). A match ends with the byte before a value, for ``assign``
#: with the first sign of the operator, for ``compare`` with the opening quote. ``\s`` is no line end.
GRAMMAR = [
    ("assign", r"(?:" + _STEMS + r")[A-Za-z0-9_\x80-\xff-]*[\\\"'`\])]*\s*(?:[:=]|!=|->|,\s*[\"']|/ |to [\"'`]| [\"'])", False),
    ("uri", r"[\w+.-]://[^\s\n\"'`@/:]*:", True),
    ("user", r"[\s\n\x00\"'(](?:-u|--user)[ =][\"']?[^\s\n:\"']+:", True),
    ("short", r"[^\w](?:mysql\w*|psql|mongo\w*|sshpass|redis-cli|mariadb\w*|ldap\w*|zip|7z|openssl)(?:[^\w|;\n][^|;\n]*)?\s-[pa]", True),
    ("long", r"--(?:password|passwd|pass|token|secret|api-?key|auth)[ =][\"']?", True),
    ("header", r"[^\w](?:bearer|basic|token)\s+", False),
    ("identified", r"[^\w](?:identified\s+(?:with\s+[^\s\n]+\s+)?by|password(?:\s+for\s+[^\s\n]+)?\s+is)\s+[\"'`]?", False),
    ("login", r"(?:login|signin|sign_in|connect|auth\w*)\(\s*[\"'][^\"'\n]*[\"']\s*,\s*[\"']", False),
    ("note", r"[^\w](?:was\s+[^\s\n]+\s+->\s+|login\s+[^\s\n]+\s+/\s+|remove:\s*[\w.@-]+\s*[=:]\s*)", False),
    ("until", r"[^\w]was\s+", False),
    ("compare", r"(?:[=!]==?|equals\(|eql?\?\s*\(?|compare\w*\(|strcmp\([^,\n]*,)\s*[\"'`]", True),
    ("armour", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", True),
    *((f"token{i}", a, True) for i, (a, _) in enumerate(TOKENS)),
]
TAGS = [tag for tag, _, _ in GRAMMAR]


_SPACE = frozenset(b" \t\x0b\x0c\r")


class _Nfa:
    """Thompson's construction from the tree of a regular expression (literals, classes,
    repetition, groups, alternatives), over bytes."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.case = True

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def chars(self, op, av) -> frozenset:
        if op is rc.LITERAL:
            return frozenset([av])
        if op is rc.NOT_LITERAL:
            return frozenset(range(1, 256)) - {av}
        if op is rc.ANY:
            return frozenset(range(1, 256)) - {10}
        if op is rc.RANGE:
            return frozenset(range(av[0], av[1] + 1))
        if op is rc.CATEGORY:  # the grammar uses \w and \s only
            return _SPACE if av is rc.CATEGORY_SPACE else frozenset(b for b in range(128) if chr(b).isalnum() or b == 95)
        negate, items = (av[0][0] is rc.NEGATE), [x for x in av if x[0] is not rc.NEGATE]
        got = frozenset().union(*[self.chars(*x) for x in items])
        return frozenset(range(1, 256)) - got if negate else got

    def add(self, tree, start: int) -> int:
        for op, av in tree:
            if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
                low, high, sub = av
                for _ in range(low):
                    start = self.add(sub, start)
                if high == rc.MAXREPEAT:
                    loop = self.state()
                    self.free[start].append(loop)
                    self.free[self.add(sub, loop)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.free[start].append(end)
                    for _ in range(high - low):
                        start = self.add(sub, start)
                        self.free[start].append(end)
                    start = end
            elif op is rc.SUBPATTERN:
                start = self.add(av[3], start)
            elif op is rc.BRANCH:
                end = self.state()
                for branch in av[1]:
                    at = self.state()
                    self.free[start].append(at)
                    self.free[self.add(branch, at)].append(end)
                start = end
            else:
                to, chars = self.state(), self.chars(op, av)
                if not self.case:
                    chars |= {b ^ 32 for b in chars if 65 <= b & 0xDF <= 90}
                self.moves[start].append((chars, to))
                start = to
        return start


class Automaton:
    """The deterministic automaton of GRAMMAR, by subset construction: after a byte it is in
    the state of all matches that go on and of all that may begin here. Its states are made
    when a text first leads to them; ``table`` has -1 where none has yet."""

    def __init__(self):
        nfa = _Nfa()
        root = nfa.state()
        self.tags = {}
        for i, (_, pattern, nfa.case) in enumerate(GRAMMAR):
            at = nfa.state()
            nfa.free[root].append(at)
            self.tags[nfa.add(rp.parse(pattern), at)] = 1 << i

        def reach(state: int) -> frozenset:
            got, todo = {state}, [state]
            while todo:
                for s in nfa.free[todo.pop()]:
                    if s not in got:
                        got.add(s)
                        todo.append(s)
            return frozenset(s for s in got if nfa.moves[s] or s in self.tags)

        sets = {m[0] for moves in nfa.moves for m in moves}
        signature: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        self.classes = np.array([signature.setdefault(tuple(b in s for s in ordered), len(signature)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(signature))]
        to = [[(chars, reach(t)) for chars, t in moves] for moves in nfa.moves]
        self.steps = [[frozenset().union(*[r for chars, r in moves if b in chars]) for b in sample] if moves else None for moves in to]
        self.base, self.width = reach(root), len(sample)
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.table = np.full(256 * self.width, -1, np.int32)  # states are kept multiplied by the width
        self.accepts = np.zeros(256, np.int64)
        self._state(self.base)

    def _state(self, states: frozenset) -> int:
        k = self.number.setdefault(states, len(self.sets))
        if k == len(self.sets):
            self.sets.append(states)
            if k == len(self.accepts):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
                self.accepts = np.concatenate([self.accepts, np.zeros(k, np.int64)])
            self.accepts[k] = sum(self.tags.get(s, 0) for s in states)
        return k * self.width

    def step(self, at: np.ndarray) -> np.ndarray:
        """The states behind places of the table (a state plus a class of bytes)."""
        got = self.table[at]
        if (got < 0).any():
            for place in np.unique(at[got < 0]).tolist():
                k, c = divmod(place, self.width)
                reached = self.base.union(*[self.steps[s][c] for s in self.sets[k] if self.steps[s]])
                new = self._state(reached)
                self.table[place] = new
            got = self.table[at]
        return got


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def hits(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes with which matches end, ascending, each once, and their tags as bits."""
    auto = automaton()
    code = auto.classes[np.frombuffer(data, np.uint8)].astype(np.int32)
    step = WINDOW - OVERLAP
    starts = np.arange(0, max(1, len(code)), step)
    padded = np.concatenate([code, np.full(WINDOW, int(auto.classes[0]), np.int32)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts].T.copy()
    places, tags = [], []

    def run(which, state: np.ndarray, a: int, b: int) -> np.ndarray:
        for i in range(a, b):
            state = auto.step(state + lanes[i, which])
            tag = auto.accepts[state // auto.width]
            on = np.flatnonzero(tag)
            if len(on):
                places.append(starts[which][on] + i)
                tags.append(tag[on])
        return state

    every = slice(None)
    behind = run(every, np.zeros(len(starts), np.int32), 0, OVERLAP)
    end = run(every, behind, OVERLAP, WINDOW)
    while len(late := np.flatnonzero(behind[1:] != end[:-1]) + 1):  # matches longer than the overlap
        behind[late] = end[late - 1]
        end[late] = run(late, behind[late], OVERLAP, WINDOW)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, tag = np.concatenate(places), np.concatenate(tags)
    order = np.argsort(at, kind="stable")
    at, tag = at[order], tag[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    tag = np.bitwise_or.reduceat(tag, first)
    at = at[first]
    return at[at < len(code)], tag[at < len(code)]


# reading a value

_VALUE = r"""(?:\(?\s*(?:[A-Za-z_][\w.:]*\(\s*)*(?:new\s+)?[urbfBLR@]{0,2}(?P<q>["'`]|\\["'])(?P<s>(?:(?!(?P=q)).)*)(?P=q)|(?P<u>[^\s;,'"`(){}\[\]<>|]+)(?P<next>[(\[]?))"""
ASSIGN = re.compile(
    r"""(?P<k>[^\W\d][\w\u0300-\u036f-]*)\\?["'`]?\]?\)?\s*(?P<op>:(?!:)\s*[\w:<>&'\[\]| ]{1,40}?\s*=(?![=>])|:=|=>|->|={1,3}(?![=>])|!==?|:(?!:)|,(?=\s*["'])|\s+to\s+(?=`)|\s+(?=["']))\s*""" + _VALUE
)
# What follows an accepted place, and whether only a secret can stand there.
VALUES = {
    "uri": (re.compile(r"(?P<v>[^\s\"'`@/]+)@"), True),
    "user": (re.compile(r"(?P<v>[^\s\"'`]+)"), True),
    "short": (re.compile(r"(?P<v>[^\s\"'`-][^\s\"'`]*)"), True),
    "long": (re.compile(r"(?P<v>[^\s\"'`]+)"), True),
    "login": (re.compile(r"(?P<v>[^\"']+)[\"']"), True),
    "identified": (re.compile(r"(?P<v>[^\s\"'`;]+)"), True),
    "header": (re.compile(r"(?P<v>[A-Za-z0-9+/=_.~!@#$%^&*?-]{6,})"), False),
    "note": (re.compile(r"(?P<v>[^\s\"'`]+)"), False),
    "until": (re.compile(r"(?=\S+\s+until)(?P<v>[^\s\"'`]+)", re.I), False),
    "compare": (re.compile(r"(?<=(?P<q>[\"'`]))(?P<v>(?:(?!(?P=q)).)+)(?P=q)"), False),
}
TOKEN_AT = [re.compile(r"(?<![A-Za-z0-9_])" + a + b) for a, b in TOKENS]
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
ARMOUR_END = re.compile(r"-----END [A-Z0-9 ]*(PRIVATE|PUBLIC|CERTIFICATE)[A-Z0-9 ]*-----")
BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_B64 = re.compile(r"[A-Za-z0-9+/=]*[A-Za-z0-9=][A-Za-z0-9+/=]*")
_KEY_LINE = re.compile(r"[\s\"'`+#/*|.>-]*(?P<b>[A-Za-z0-9+/=]+(?: {2,}[A-Za-z0-9+/=]+)*)[\"'`+,.\s\\;)]*")
_PIECE = re.compile(r"""[ \t]*(?:\+|\.|\\|<<|\|\||&|\.\.)?[ \t]*\\?\r?\n[ \t]*(?:\+|\.|<<|&|\.\.)?[ \t]*[urbf]?(?P<q>["'`])(?P<s>(?:(?!(?P=q)).)*)(?P=q)""")
_SAME = re.compile(r"""[ \t]*(?:\+|\.|<<|\|\||&|\.\.)[ \t]*(?P<q>["'`])(?P<s>(?:(?!(?P=q)).)*)(?P=q)""")
_NUMBERS = re.compile(r"[^\n]{0,40}?[\[{(]\s*(?P<v>(?:0x[0-9a-fA-F]{1,2}|\d{1,3})(?:\s*,\s*(?:0x[0-9a-fA-F]{1,2}|\d{1,3})){5,})")
_BODY_LINE = re.compile(r"[\s\"'+#/*|.>-]*[A-Za-z0-9+/=]{8,}(?:\\n)?[\"'+,.\s\\]*")
_LONE = re.compile(r"""\s*(?:\+|\.)?\s*(?P<q>["'])(?P<s>[^"'\s]{6,})(?P=q)\s*(?:[;,)+.\\]|\|\|)*\s*""")

#: What may stand behind a piece of a string that goes on in the next line.
_JOINED = re.compile(r"""\\?["'`][ \t]*(?:\+|\.|\\|<<|\|\||&|\.\.)?[ \t]*\\?\s*""")

_LOOKUP = re.compile(r"getenv|environ|\benv\b|\bENV\b|env::|config|settings|vault|secrets?\.|lookup|fetch|require", re.I)

Span = tuple[int, int]


def _pieces(text: str, at: int, first: Span) -> list[Span]:
    """The pieces of a string that goes on in the next ones."""
    out = [first]
    while True:
        m = _PIECE.match(text, at) or _SAME.match(text, at)
        if not m or not m["s"]:
            break
        out.append(m.span("s"))
        at = m.end()
    return out


def _secret_text(v: str, named: bool) -> bool:
    m = re.match(r"(?:bearer|basic|token|digest)\s+(\S+)$", v, re.I)
    return secretish(m[1] if m else v, named)


def _basic(v: str) -> bool:
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except ValueError:
        return False


def _line(text: str, p: int) -> Span:
    end = text.find("\n", p)
    return text.rfind("\n", 0, p) + 1, len(text) if end < 0 else end


_BEHIND_NAME = " \t\x0b\x0c\r:=->!,/\"'`])\\"


def _name_start(text: str, a: int, p: int) -> int:
    """Where the name begins behind which the automaton stopped at p, in a line from a on: back
    over signs (and a ``to`` between two of them), then over the name, then on to its first letter."""
    stop = p
    while p > a and text[p - 1] in _BEHIND_NAME:
        p -= 1
    if text.endswith((" to", "\tto"), a, p):
        p -= 2
        while p > a and text[p - 1] in _BEHIND_NAME:
            p -= 1
    while p > a and (text[p - 1].isalnum() or text[p - 1] in "_-" or "\u0300" <= text[p - 1] <= "\u036f"):
        p -= 1
    while p < stop and (text[p].isdigit() or not text[p].isalnum() and text[p] != "_"):
        p += 1
    return p


def _assigned(text: str, at: int, b: int) -> Iterator[list[Span]]:
    """Value of the assignment whose name begins at ``at``, in a line that ends at b."""
    m = ASSIGN.match(text, at, b)
    if not m or not names_secret(m["k"]):
        return
    begin = max(m.start("q") if m["s"] is not None else m.end("op"), m.end("k"))
    if _LOOKUP.search(text, m.end("op"), begin):
        return
    numbers = _NUMBERS.match(text, m.end("op"), b)
    if numbers:
        values = [int(x, 0) for x in re.findall(r"0x[0-9a-fA-F]+|\d+", numbers["v"])]
        if all(32 < x < 127 for x in values) and secretish("".join(map(chr, values)), True):
            yield [numbers.span("v")]
            return
    op = m["op"].strip()
    if m["s"] is not None:
        if op in ("==", "===", "!=", "!==", ",", "") and not secretish(m["s"], False):
            return
        parts = _pieces(text, m.end(), m.span("s"))
        whole = "".join(text[i:j] for i, j in parts)
        if len(parts) > 1 and _secret_text(whole, True):
            yield parts
        elif _secret_text(m["s"].replace("\\n", ""), True) or _escaped(m["s"]):
            skip = re.match(r"(?:bearer|basic|token|digest)\s+", m["s"], re.I)
            yield [(m.start("s") + (skip.end() if skip else 0), m.end("s"))]
    elif m["u"] and not m["next"] and op not in ("==", "===", "!=", "!=="):
        v = m["u"].rstrip("\\")
        if secretish(v, True) and (secretish(v, False) or op in (":", "=", "->") and not re.fullmatch(r"[\w.:*&>-]+", v) or _plain_setting(text[m.end("u") : b], m["u"])):
            yield [(m.start("u"), m.start("u") + len(v))]


def _at(text: str, p: int, tag: str) -> Iterator[list[Span]]:
    """The value that begins behind p, where the automaton accepted with ``tag``, in pieces."""
    a, b = _line(text, p)
    if tag == "armour":
        body = _armoured(text, p + 1)
        if body is not None:
            start = text.rfind("-----BEGIN", a, p)
            yield [(start, start), *body]
    elif tag.startswith("token"):
        i = int(tag[5:])
        start = p
        while start > a and not TOKEN_AT[i].match(text, start, b) and p - start < 20:  # the beginning is at most 20 long
            start -= 1
        m = TOKEN_AT[i].match(text, start, b)
        if m and "EXAMPLE" not in m[0] and len(set(m[0])) > 6:
            yield [m.span()]
    elif m := VALUES[tag][0].match(text, p + 1, b):
        v = m["v"]
        if tag == "uri":
            user = text[text.rfind("://", a, p) + 3 : p]
            good = not REFERENCE.search(v) and not REFERENCE.search(user) and not PLACEHOLDER.fullmatch(v) and len(v) >= 4 and not v.isdigit()
        elif tag == "header":
            good = secretish(v, False) or TOKEN.match(v) or text[a:p].rstrip()[-5:].lower() == "basic" and _basic(v)
        else:
            good = secretish(v, VALUES[tag][1])
        if good:
            yield [m.span("v")]


def _plain_setting(rest: str, value: str) -> bool:
    """Whether an unquoted value is the whole rest of a line: a setting and no expression."""
    return not rest.strip(" \t\r'\"`,;\\") and "." not in value and not NAME.fullmatch(value)


def _escaped(v: str) -> bool:
    if "\\x" not in v and "\\u00" not in v:
        return False
    return secretish(re.sub(r"\\(?:x|u00)([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), v), True)


def _body(text: str, a: int, b: int) -> list[Span]:
    """Body of a key in text[a:b]: long runs wherever they stand, and all that stands alone in its line."""
    inner = re.sub(r"\\[nr]", "  ", text[a:b])  # escaped line ends stay
    found = {m.span() for m in BODY.finditer(inner)}
    at = 0
    for line in inner.split("\n") if found else ():
        if m := _KEY_LINE.fullmatch(line):
            found.update((at + m.start("b") + x.start(), at + m.start("b") + x.end()) for x in _B64.finditer(m["b"]))
        at += len(line) + 1
    return [(a + i, a + j) for i, j in sorted(found)]


def _armoured(text: str, start: int) -> list[Span] | None:
    """Body of a private key from its opening marker on; None if it is a mention only."""
    end = ARMOUR_END.search(text, start)
    stop = end.start() if end else len(text)
    if not end:  # up to the last line that may be part of it
        stop = start
        for line in text[start:].splitlines(keepends=True):
            if stop > start and not _BODY_LINE.fullmatch(line.rstrip()) and "\\n" not in line and ":" not in line:
                break
            stop += len(line)
    spans = _body(text, start, stop)
    if spans or not text[start:stop].strip("- \r\n\"'`"):
        return spans
    return None


def _from_above(text: str) -> list[list[Span]]:
    """A value that began above the text: a key's body with its closing marker in the line
    behind it or the next, or a few lone pieces of a string."""
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if not _BODY_LINE.fullmatch(text, at, stop):
            break
        at = stop + 1
    second = _line(text, min(len(text), _line(text, at)[1] + 1))[1]
    end = ARMOUR_END.search(text, at, second) if at else None
    last = text[at : end.start()] if end else ""
    if end and end[1] == "PRIVATE" and (not last.strip(" \t\"'#/*|>-") or _KEY_LINE.fullmatch(last) and last.rstrip(" \t\"'#/*|>-").count("\n") <= 1):
        return [_body(text, 0, end.start()) or [(0, text.find("\n"))]]
    lone, at = [], 0
    while m := _LONE.fullmatch(text, at, _line(text, at)[1]):
        lone.append(m.span("s"))
        if text[at : m.end()].rstrip()[-1:] in ";)" or m.end() == len(text):
            break
        at = m.end() + 1
    joined = "".join(text[i:j] for i, j in lone)
    if 0 < len(lone) <= 4 and max(j - i for i, j in lone) <= 44 and re.search(r"\d", joined) and secretish(joined, True) and _flips(joined) >= 2 and "/" not in joined:
        return [lone]
    return []


class Head(NamedTuple):
    """What a text holds of a value if one goes on from above: its kind, its places, and whether
    it reaches the text's end. Whether one does, the text before must tell."""

    kind: str
    spans: list[Span]
    through: bool


def _heads(text: str) -> list[Head]:
    """Lines at the beginning that could be a key's body, and those that could be lone pieces of a string."""
    out, at = [], 0
    while at < len(text):
        end = _line(text, at)[1]
        if not _BODY_LINE.fullmatch(text, at, end):
            break
        at = end + 1
    if at and (body := _body(text, 0, min(at, len(text)))):
        out.append(Head("key", body, not text[at:].strip()))
    pieces, at, ended = [], 0, False
    while not ended and at < len(text) and (m := _LONE.fullmatch(text, at, _line(text, at)[1])):
        pieces.append(m.span("s"))
        ended = m[0].rstrip()[-1:] in ";)"
        at = m.end() + 1
    return [*out, Head("string", pieces, not ended and not text[at:].strip())] if pieces else out


def _open_end(text: str, places: np.ndarray, tags: np.ndarray, values: list[list[Span]]) -> tuple[str, int] | None:
    """(kind, beginning) of a value that may go on below the text: a key without its closing
    marker, or a string of which nothing but a sign of joining follows."""
    keys = places[(tags >> TAGS.index("armour") & 1).astype(bool)]
    if len(keys):
        start = text.rfind("-----BEGIN", 0, int(keys[-1]))
        rest = text[int(keys[-1]) + 1 :]
        if [(start, start)] in [v[:1] for v in values] and not ARMOUR_END.search(rest) and all(_BODY_LINE.fullmatch(x) or ":" in x or not x.strip("\"'`+ \t\r\\n") for x in rest.split("\n")):
            return "key", start
    if values:
        last = max(values, key=lambda v: v[-1][1])
        if _JOINED.fullmatch(text, last[-1][1]):
            return "string", last[0][0]
    return None


def spans(text: str, places: np.ndarray, tags: np.ndarray) -> list[list[Span]]:
    """Values of a text, each as the spans of its pieces; a value that began above the text
    is the first. ``places``: where the automaton's matches end, in characters, with tags."""
    out = _from_above(text)
    names, seen = set(), set()
    for p, bits in zip(places.tolist(), tags.tolist()):
        for i, tag in enumerate(TAGS):
            if not bits >> i & 1:
                continue
            if tag == "assign":
                a, b = _line(text, p)
                start = _name_start(text, a, p)
                if start in names:
                    continue
                names.add(start)
                found = _assigned(text, start, b)
            else:
                found = _at(text, p, tag)
            for value in found:
                if tuple(value) not in seen:
                    seen.add(tuple(value))
                    out.append(value)
    return out


class Found(NamedTuple):
    """What was found in text ``k``: its values, what its head would hold of a value of each kind
    from above, and what may go on below it."""

    k: int
    values: list[list[Span]]
    heads: list[Head]
    end: tuple[str, int] | None


def _scan(texts: list[str]) -> Iterator[Found]:
    """What the texts hold that hold anything, in blocks of bounded size."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 4_000_000):
            size += len(texts[j]) + 1
            j += 1
        block = texts[i:j]
        coded = [t.encode("utf-8", "replace") for t in block]
        ends = np.cumsum([len(c) + 1 for c in coded])
        at, tags = hits(b"\x00" + b"\x00".join(coded))
        at = at - 1  # the sign before the first text
        which = np.searchsorted(ends, at, "right")
        first = dict(zip(*np.unique(which, return_index=True)))
        count = dict(zip(*np.unique(which, return_counts=True)))
        for k, text in enumerate(block):
            own = slice(first[k], first[k] + count[k]) if k in first else slice(0, 0)
            places = at[own] - (ends[k] - len(coded[k]) - 1)
            if len(coded[k]) != len(text) and len(places):  # bytes to characters
                chars = np.cumsum((np.frombuffer(coded[k], np.uint8) & 0xC0) != 0x80) - 1
                places = chars[places]
            values = spans(text, places, tags[own])
            heads = [] if values and values[0] in _from_above(text) else _heads(text)
            if values or heads:
                yield Found(i + k, values, heads, _open_end(text, places, tags[own], values))
        i = j


def _masked(text: str, values: list[list[Span]]) -> str:
    out = list(text)
    for value in values:
        for a, b in value:
            number = re.fullmatch(r"[\s,0-9a-fA-Fx]+", text[a:b]) and "," in text[a:b]
            for k in range(a, b):
                if not out[k].isspace() and not (number and not out[k].isdigit()):
                    out[k] = "0" if number else "*"
    return "".join(out)


def _scanned(chunks: DataFrame) -> DataFrame:
    """Values, heads and open ends of all rows: what, id, path, line_no, start_char, end_char,
    kind, last (the last line that an open end or a head reaching its chunk's end covers)."""
    names = ["what", "id", "path", "line_no", "start_char", "end_char", "kind", "last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["content"]]
            ids, paths, starts = pdf["id"].tolist(), pdf["path"].tolist(), pdf["start_line"].tolist()
            rows = []
            for k, values, heads, end in _scan(texts):
                first, bottom = int(starts[k]), int(starts[k]) + texts[k].count("\n")
                for value in values:
                    a, b = next((s for s in value if s[0] < s[1]), value[0])
                    rows.append(("value", ids[k], paths[k], first + texts[k].count("\n", 0, value[0][0]), a, b, None, None))
                for head in heads:
                    rows.append(("head", ids[k], paths[k], first, *head.spans[0], head.kind, bottom if head.through else None))
                if end:
                    rows.append(("open", ids[k], paths[k], first + texts[k].count("\n", 0, end[1]), None, None, end[0], bottom))
            yield pd.DataFrame(rows, columns=names)

    source = chunks.select("id", "path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content")
    return source.mapInPandas(run, "what string, id string, path string, line_no int, start_char int, end_char int, kind string, last int").distinct()


def _entered(scanned: DataFrame) -> DataFrame:
    """The heads into which a value goes on: those of chunks that begin on a line of the same file
    that an open value covers, be it open since several chunks."""
    lines = F.explode(F.sequence(F.col("line_no") + 1, F.col("last") + 1)).alias("line_no")
    heads, new = scanned.where("what = 'head'"), scanned.where("what = 'open'")
    found = heads.where("false")
    while not new.isEmpty():
        covered = new.where("last IS NOT NULL").select("path", "kind", lines).distinct()
        new = cut(heads.join(covered, ["path", "kind", "line_no"], "left_semi").join(found, ["id", "path", "line_no", "kind"], "left_anti"))
        found = found.unionByName(new)
    return found


def credentials(chunks: DataFrame) -> DataFrame:
    """One row for each value: id, path, line_no, start_char, end_char (of its first piece
    within the content, 0-based). A value that a chunk of the same file leaves open is
    followed into the chunks that begin within it or just behind.

    A null id, path or start_line is passed on (line_no counts from 1 then); null and
    empty contents hold none; repeated rows are reported once; extra columns are ignored;
    an empty table gives no rows. Whole contents are read.
    """
    scanned = cut(_scanned(chunks))
    both = scanned.where("what = 'value'").unionByName(_entered(scanned))
    return both.select("id", "path", "line_no", "start_char", "end_char").distinct()


#: Chunks into which a value goes on, up to which they are broadcast (about 200 bytes each).
BROADCAST_ROWS = 100_000


def masked(chunks: DataFrame) -> DataFrame:
    """Distinct rows with every value's characters replaced by asterisks (numbers of a byte
    array by zeros) and all else unchanged: id, path, language, start_line, end_line,
    content, n_values. Contents are read twice: first for what goes on into other chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, kinds = pdf["content"].tolist(), pdf["kinds"].tolist()
            n = np.zeros(len(pdf), np.int32)
            for k, values, heads, _ in _scan([t or "" for t in content]):
                values = [*(h.spans for h in heads if kinds[k] is not None and h.kind in kinds[k]), *values]
                content[k] = _masked(content[k], values)
                n[k] = len(values)
            yield pdf.drop(columns="kinds").assign(content=content, n_values=n)

    names = ["id", "path", "language", "start_line", "end_line", "content"]
    rows = chunks.select(names).distinct()
    entered = cut(_entered(cut(_scanned(chunks).where("what <> 'value'"))).groupBy("id", "path", F.col("line_no").alias("start_line")).agg(F.collect_set("kind").alias("kinds")))
    n = entered.count()
    if n:
        right = F.broadcast(entered) if n <= BROADCAST_ROWS else entered
        same = (rows["id"] == right["id"]) & (rows["path"] == right["path"]) & (F.coalesce(rows["start_line"], F.lit(1)) == right["start_line"])
        rows = rows.join(right, same, "left").select(*[rows[c] for c in names], "kinds")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    return rows.mapInPandas(run, "id string, path string, language string, start_line int, end_line int, content string, n_values int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "chunks")).select("id", "line_no").distinct()


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(table(spark, sf_dir, "chunks"))


def p2_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking must leave: the rows, and the white space of their contents in its places."""
    m = masked(table(spark, sf_dir, "chunks"))
    return m.select("id", "path", "language", "start_line", "end_line", F.md5(F.regexp_replace("content", r"[^ \t\r\n]", "x")).alias("layout_md5"))


ORACLES = {
    "p2_layout": r"SELECT id, path, language, start_line, end_line, md5(regexp_replace(content, '[^ \t\r\n]', 'x', 'g')) AS layout_md5 FROM (SELECT DISTINCT id, path, language, start_line, end_line, content FROM chunks)"
}
QUERIES = {"p2_layout": p2_layout, "p2_found": p2_found, "p2_masked": p2_masked}
