"""Where units of source files begin: functions, classes and other definitions, headings,
outermost keys, sections, statements and rules, with their place in the file's tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple


class Unit(NamedTuple):
    """``start``: the first comment, decorator or attribute line above, else ``own``;
    ``end``: its last line; ``depth``: how many units it stands in. Lines count from 0."""

    start: int
    own: int
    end: int
    depth: int


# Extension -> way of reading.
FAMILY = {
    ext: family
    for family, exts in {
        "script": "js jsx mjs cjs ts tsx", "java": "java", "c": "c h cpp cc cxx hpp hh", "rust": "rs", "go": "go", "php": "php",
        "python": "py", "ruby": "rb", "shell": "sh bash zsh", "markdown": "md", "yaml": "yml yaml", "json": "json",
        "sections": "toml conf", "sql": "sql", "style": "css scss",
    }.items()
    for ext in exts.split()
}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _keep_quotes(s: str) -> str:
    return re.sub(r"[^\n]", " ", s[1:-1]).join((s[0], s[-1])) if len(s) > 1 else s


_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
LEXERS = {
    "script": (_SLASHES, rf"{_DQ}|{_SQ}|`(?:\\.|[^`\\])*`"),
    "java": (_SLASHES, rf'"""(?:\\.|[^\\])*?"""|{_DQ}|{_SQ}'),
    "c": (_SLASHES + r"|^[ \t]*#(?:\\\n|[^\n])*", rf'R"\((?:.*?)\)"|{_DQ}|' + r"'(?:\\.|[^'\\\n]){1,4}'"),
    "rust": (_SLASHES, rf'r(#+)".*?"\1|r"[^"]*"|"(?:\\.|[^"\\])*"|' + r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"),
    "go": (_SLASHES, rf"{_DQ}|`[^`]*`|" + r"'(?:\\.|[^'\\\n]){1,8}'"),
    "php": (_SLASHES + r"|#(?!\[)[^\n]*", r"<<<[ \t]*['\"]?(\w+)['\"]?\n.*?\n[ \t]*\1\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"),
    "python": (r"#[^\n]*", rf"(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))|{_DQ}|{_SQ}"),
    "ruby": (r"^=begin\b.*?^=end\b[^\n]*|#(?!\{)[^\n]*", rf"<<[~-]?['\"]?([A-Z_]\w*)['\"]?[^\n]*\n.*?\n[ \t]*\1\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"),
    "shell": (r"(?:(?<=\s)|^)#[^\n]*", r"<<-?[ \t]*['\"\\]?(\w+)['\"]?[^\n]*\n.*?\n[ \t]*\1\b|\"(?:\\.|[^\"\\])*\"|'[^']*'"),
    "sql": (r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"\$(\w*)\$.*?\$\1\$|'(?:''|[^'])*'|\"[^\"\n]*\""),
    "style": (r"/\*.*?(?:\*/|\Z)|(?<![:\w])//[^\n]*", rf"{_DQ}|{_SQ}"),
    "json": (r"\Z(?!\Z)", r'"(?:\\.|[^"\\\n])*"'),
}
# a string's own group is the third, after those of the comment and the string
_LEX = {k: re.compile(rf"(?P<comment>{c})|(?P<string>{s})".replace(r"\1", r"\3"), re.S | re.M) for k, (c, s) in LEXERS.items()}


def _clean(text: str, family: str) -> tuple[list[str], str]:
    """(lines without comments, text without comments and contents of strings); all
    line ends stay."""
    lex = _LEX[family]
    directive = "#" if family == "c" else "\x00"  # these lines are no comments
    bare = lex.sub(lambda m: _blank(m) if m["comment"] is not None and m[0].lstrip()[:1] != directive else m[0], text)
    clean = lex.sub(lambda m: _blank(m) if m["comment"] is not None else _keep_quotes(m[0]), text)
    if family == "php":
        clean = re.sub(r"<\?(?:php|=)?|\?>", _blank, clean)
    return bare.split("\n"), clean


# braces

_CONTROL = re.compile(r"(?:\}\s*)?(?:if|else|elseif|for|foreach|while|do|switch|try|catch|finally|with|match|loop|unsafe|return|synchronized|case|default|select|throw|yield|await|new|defer|go)\b")
_PREFIX = re.compile(r"\s*(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*|#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\s*)+")
_TYPES = {
    "script": r"(?:(?:export|default|declare|abstract|public|private|protected|static|const)\s+)*(?:class|interface|enum|namespace|module|type)\s+[\w$\"']|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*class\b|export\s+default\s+class\b",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+\w",
    "c": r"(?:template\s*<[^{;]*>\s*)?(?:(?:typedef|static|extern|const|inline|export)\s+)*(?:class|struct|union|enum(?:\s+(?:class|struct))?|namespace)\b(?![^{;]*\)\s*(?:const|noexcept|override)?\s*$)|using\s+\w+\s*=|extern\s*\"",
    "rust": r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+|default\s+)*(?:struct|enum|union|trait|impl|mod|type)\b|macro_rules!",
    "go": r"type\b",
    "php": r"(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum|namespace)\s+[\w\\]",
}
_SPACES = re.compile(r"(?:export\s+|declare\s+)*(?:namespace|module)\s|(?:pub(?:\s*\([^)]*\))?\s+)?mod\s|extern\s*\"|namespace\b")
_FUNCTIONS = {
    "script": r"(?:^|[^\w$.])function\b|=>\s*$|^(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract|export|default|\*)\s+|\*\s*)*[\w$#\[\].\"']+\??\s*(?:<[^()]*>)?\s*\(.*\)\s*(?::\s*[^=]+)?$",
    "java": r"->\s*$|^(?:[\w<>\[\],.?&@]+\s+)*[\w$]+\s*\(.*\)\s*(?:throws\s+[\w.,\s]+)?$|^static\s*$",
    "c": r"^(?!.*=\s*$)[^=]*[\w>~\]]\s*\(.*\)\s*(?:const|noexcept|override|final|mutable|volatile|&|->\s*[\w:<>*& ]+|:\s*\w.*|\s)*$|\[[^\[\]]*\]\s*(?:\([^{;]*\))?\s*(?:mutable|noexcept|->\s*[\w:<>*& ]+|\s)*$|operator",
    "rust": r"\bfn\s+\w+|\|[^|]*\|\s*(?:->\s*[^{]+)?$|\bmove\s*\|",
    "go": r"\bfunc\b",
    "php": r"\bfunction\b|\bfn\s*\(",
}
_TYPE = {k: re.compile(v) for k, v in _TYPES.items()}
_FUNCTION = {k: re.compile(v, re.S) for k, v in _FUNCTIONS.items()}
_ARROW = re.compile(r"(?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|readonly\s+)*(?:(?:const|let|var)\s+)?[\w$]+\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^=]+)?=>", re.S)
_BODILESS = {
    "script": re.compile(r"(?:export\s+|declare\s+)*type\s+\w|(?:export\s+|declare\s+)*(?:abstract\s+)[\w$]+\s*\("),
    "c": re.compile(r"typedef\b|using\s+\w+\s*=|(?:class|struct|union|enum(?:\s+class)?)\s+\w+\s*$"),
    "rust": re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:struct|type|union)\s|(?:pub(?:\s*\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s"),
    "java": re.compile(r"(?:[\w<>\[\],.?]+\s+)+\w+\s*\([^=]*\)\s*(?:throws\s+[\w.,\s]+)?$|(?:public\s+)?record\b"),
    "php": re.compile(r"(?:(?:abstract|public|protected|private|static)\s+)+function\b|function\s+\w+\s*\([^{]*$"),
    "go": re.compile(r"type\s+\w"),
}
_MARK = re.compile(r"[{}();\n]")


def _braces(text: str, family: str) -> tuple[list[str], str, list[tuple[int, int, int]], set[int]]:
    """Units as (own line, end line, depth), and lines of decorators and attributes."""
    bare, clean = _clean(text, family)
    units: list[list[int]] = []
    marks: set[int] = set()
    stack: list[tuple[bool, int | None, int, int, int]] = []  # outside: in a function, (own unit), paren depth, header's start and line
    inside, paren, head, line = False, 0, 0, 0
    head_line = 0
    function, type_, bodiless = _FUNCTION[family], _TYPE[family], _BODILESS.get(family)
    depth = 0

    def begin(h: str, at: int) -> tuple[str, int]:
        """The header without decorators, and its first line; decorators' lines are noted."""
        lead = len(h) - len(h.lstrip())
        first = at + h.count("\n", 0, lead)
        h = h.lstrip()
        if (m := _PREFIX.match(h)) and m.end():
            body = h[m.end() :]
            own = first + h.count("\n", 0, m.end())
            if body.strip():
                marks.update(range(first, own))
                return body.strip(), own
        return h.strip(), first

    for m in _MARK.finditer(clean):
        c, at = m[0], m.start()
        if c == "\n":
            line += 1
            if family == "go" and paren == 0 or head == at:
                head, head_line = at + 1, line
        elif c == "(":
            paren += 1
        elif c == ")":
            paren = max(0, paren - 1)
        elif c == "{":
            h, own = begin(clean[head:at], head_line)
            fn = ty = False
            if h and not _CONTROL.match(h):
                ty = bool(type_.match(h)) and not (family == "c" and h.endswith(")"))
                fn = not ty and bool(function.search(h))
            unit = None
            if (ty or fn) and not inside and paren == 0 and h != "static":
                if not (ty and _SPACES.match(h)) and not re.match(r"[!(]|\(?function\s*\(", h):
                    unit = len(units)
                    units.append([own, own, depth])
                    depth += 1
            stack.append((inside, unit, paren, head, head_line))
            inside = inside or fn
            paren = 0
            head, head_line = at + 1, line
        elif c == "}":
            before = 0, 0
            if stack:
                inside, unit, paren, *before = stack.pop()
                if unit is not None:
                    units[unit][1] = line
                    depth -= 1
            head, head_line = before if paren else (at + 1, line)  # braces between parentheses are part of the header
        else:
            if paren == 0:
                if not inside:
                    h, own = begin(clean[head:at], head_line)
                    if h and (family == "script" and _ARROW.match(h) or bodiless and bodiless.match(h)) and not (family == "java" and ("=" in h or not stack)):
                        units.append([own, line, depth])
                head, head_line = at + 1, line
    for _, unit, *_ in stack:
        if unit is not None:
            units[unit][1] = line
    if family == "go":
        found = {u[0] for u in units}
        level = 0
        for i, s in enumerate(clean.split("\n")):
            if level == 0 and re.match(r"type\s+\w+", s) and i not in found:
                units.append([i, i, 0])
            level += s.count("{") - s.count("}")
    return bare, clean, [tuple(u) for u in units], marks


# indentation


def _indented(text: str, family: str) -> tuple[list[str], str, list[tuple[int, int, int]], set[int]]:
    bare, clean = _clean(text, family)
    marks: set[int] = set()
    units: list[list[int]] = []
    stack: list[tuple[int, bool, int | None]] = []
    paren = 0
    decorator = False
    last = 0
    if family == "python":
        opens = re.compile(r"(?:async\s+def|def|class)\b|[\w.]+(?:\s*:[^=]+)?\s*=\s*lambda\b")
        is_function = re.compile(r"async|def\b|[\w.]+(?:\s*:[^=]+)?\s*=\s*lambda")
    else:
        opens = re.compile(r"(?:(?:private|public|protected|module_function|private_class_method)\s+)?(?:def\s+[\w(]|class\s+(?:[A-Z]|<<)|module\s+[A-Z])|@?@?[\w.:]+\s*=\s*(?:lambda\b|proc\b|Proc\.new|->|(?:Class|Struct|Data)\.new\b|Data\.define)|define_method\b")
        is_function = re.compile(r"(?:\w+\s+)?def\b|@?@?[\w.:]+\s*=\s*(?:lambda|proc|Proc|->)|define_method")
    for i, raw in enumerate(clean.split("\n")):
        s = raw.strip()
        if not s:
            continue
        if paren == 0:
            indent = len(raw.expandtabs(8)) - len(raw.expandtabs(8).lstrip())
            closing = family == "ruby" and (s == "end" or s.startswith(("end ", "end.", "end)")))
            while stack and stack[-1][0] >= indent:
                unit = stack.pop()[2]
                if unit is not None:
                    units[unit][1] = i if closing and (not stack or stack[-1][0] < indent) else last
            decorator = family == "python" and s.startswith("@")
            if opens.match(s):
                fn = bool(is_function.match(s))
                unit = None
                if not any(f for _, f, _ in stack):
                    unit = len(units)
                    units.append([i, i, sum(u is not None for _, _, u in stack)])
                stack.append((indent, fn, unit))
        if decorator:
            marks.add(i)
        paren = max(0, paren + sum(map(s.count, "([{")) - sum(map(s.count, ")]}")))
        last = i
    for _, _, unit in stack:
        if unit is not None:
            units[unit][1] = last
    return bare, clean, [tuple(u) for u in units], marks


# other families


def _shell(text: str, family: str):
    bare, clean = _clean(text, family)
    units: list[list[int]] = []
    level, until = 0, None
    lines = clean.split("\n")
    for i, raw in enumerate(lines):
        s = raw.strip()
        if until is None and re.match(r"(?:function\s+[\w:.-]+\s*(?:\(\s*\))?|[\w:.-]+\s*\(\s*\))\s*(?:\{|\(|$)", s) and ("{" in s or "(" in s.split(")")[-1] or (i + 1 < len(lines) and lines[i + 1].strip().startswith("{"))):
            units.append([i, i, 0])
            until = level
        level += len(re.findall(r"(?:^|\s|\))\{(?:\s|$)", raw)) - len(re.findall(r"(?:^|[\s;])\}(?:[\s;|&>]|$)", raw))
        if until is not None and level <= until and ("}" in s):
            units[-1][1] = i
            until = None
    return bare, clean, [tuple(u) for u in units], set()


def _until_next(starts: list[int], depths: list[int], n: int) -> list[tuple[int, int, int]]:
    out = []
    for k, (a, d) in enumerate(zip(starts, depths)):
        end = next((starts[j] for j in range(k + 1, len(starts)) if depths[j] <= d), n)
        out.append((a, end - 1, d))
    return out


def _markdown(text: str, family: str):
    lines = text.split("\n")
    starts, depths, fence = [], [], ""
    for i, s in enumerate(lines):
        m = re.match(r" {0,3}(`{3,}|~{3,})", s)
        if m and (not fence or m[1][0] == fence[0] and len(m[1]) >= len(fence) and not s.strip().strip(m[1][0])):
            fence = "" if fence else m[1]
        elif not fence and (h := re.match(r" {0,3}(#{1,6})(?:\s|$)", s)):
            starts.append(i)
            depths.append(len(h[1]) - 1)
    return lines, text, _until_next(starts, depths, len(lines)), set()


def _yaml(text: str, family: str):
    lines = text.split("\n")
    key = re.compile(r"""(?:"(?:\\.|[^"\\])*"|'[^']*'|[^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s|$)""")
    starts = [i for i, s in enumerate(lines) if key.match(s)]
    bare = ["" if s.lstrip().startswith("#") else s for s in lines]
    return bare, text, _until_next(starts, [0] * len(starts), len(lines)), set()


def _json(text: str, family: str):
    _, clean = _clean(text, family)
    starts, level, line = [], 0, 0
    for m in re.finditer(r"[{}\[\]\n]|\"[^\"\n]*\"\s*:", clean):
        c = m[0]
        if c == "\n":
            line += 1
        elif c in "{[":
            level += 1
        elif c in "}]":
            level -= 1
        else:
            if level == 1:
                starts.append(line)
            line += c.count("\n")
    return text.split("\n"), clean, _until_next(starts, [0] * len(starts), line + 1), set()


def _sections(text: str, family: str):
    lines = text.split("\n")
    bare = ["" if s.lstrip()[:1] in ("#", ";") else s for s in lines]
    starts, quote, level = [], "", 0
    for i, s in enumerate(lines):
        if not quote and level == 0 and re.match(r"\s*\[\[?[^\[\],]+\]\]?\s*(?:[#;].*)?$", s.rstrip("\r")):
            starts.append(i)
            continue
        for q in ('"""', "'''"):
            if s.count(q) % 2 and quote in ("", q):
                quote = "" if quote else q
        if not quote and "=" in s:
            level = 0
        if not quote:
            plain = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", s)
            level = max(0, level + plain.count("[") - plain.count("]"))
    return bare, text, _until_next(starts, [0] * len(starts), len(lines)), set()


def _sql(text: str, family: str):
    bare, clean = _clean(text, family)
    units, line = [], 0
    for part in re.split("(;)", clean):
        if part != ";" and part.strip():
            first = line + part.count("\n", 0, len(part) - len(part.lstrip()))
            units.append((first, line + part.rstrip().count("\n"), 0))
        line += part.count("\n")
    return bare, clean, units, set()


def _style(text: str, family: str):
    bare, clean = _clean(text, family)
    units: list[list[int]] = []
    stack: list[int] = []
    head, head_line, line = 0, 0, 0
    for m in _MARK.finditer(clean):
        c, at = m[0], m.start()
        if c == "\n":
            line += 1
        elif c == "{":
            h = clean[head:at]
            lead = len(h) - len(h.lstrip())
            stack.append(len(units))
            units.append([head_line + h.count("\n", 0, lead), line, len(stack) - 1])
            head, head_line = at + 1, line
        elif c == "}":
            if stack:
                units[stack.pop()][1] = line
            head, head_line = at + 1, line
        elif c == ";":
            head, head_line = at + 1, line
    return bare, clean, [tuple(u) for u in units], set()


READERS: dict[str, Callable] = {
    **dict.fromkeys(("script", "java", "c", "rust", "go", "php"), _braces), **dict.fromkeys(("python", "ruby"), _indented),
    "shell": _shell, "markdown": _markdown, "yaml": _yaml, "json": _json, "sections": _sections, "sql": _sql, "style": _style,
}


def outline(lines: list[str], path: str | None) -> list[Unit]:
    """Units of a file in order; of text of another kind none."""
    family = FAMILY.get((path or "").rpartition(".")[2])
    if family is None:
        return []
    lines = [s[:-1] if s.endswith("\r") else s for s in lines]
    bare, _, units, marks = READERS[family]("\n".join(lines), family)
    out = []
    for own, end, depth in sorted(set(units)):
        start = own
        while start > 0 and lines[start - 1].strip() and (start - 1 in marks or not bare[start - 1].strip()) and not (family == "markdown"):
            start -= 1
        if out and out[-1].own == own:
            continue
        out.append(Unit(start, own, max(own, end), depth))
    return out
