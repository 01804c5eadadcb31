"""Rule regexes are written for Python's ``re``; Spark runs Java's ``java.util.regex``.

``to_java`` rewrites the few constructs that mean something else there, and ``required_text`` lists
plain text that any match must contain, so a file can be ruled out with ``contains`` before a regex runs.
"""

from __future__ import annotations

import re

try:
    from re import _parser as _sre
except ImportError:  # Python < 3.11
    import sre_parse as _sre

# What Python's Unicode \s, \w and \d stand for, in Java class syntax.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

MAX_SPELLINGS = 12
GATE_LENGTH = 3

_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}
_BOUNDARY = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
_NOT_BOUNDARY = rf"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"

# Letters that match an ASCII letter when case is ignored, though lower() leaves them alone.
CASE_TWINS = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def is_live(pattern: str) -> bool:
    """A pattern Python refuses never matches anything."""
    try:
        re.compile(pattern)
        return True
    except (re.error, OverflowError, RecursionError):
        return False


def to_java(pattern: str, multi_line: bool = False, ignore_case: bool = True) -> str:
    flags = ("iu" if ignore_case else "") + ("s" if multi_line else "") + "d"
    if multi_line and _sre.parse(pattern).getwidth()[0] == 0:
        # Where the first choice is the empty match, Python goes on to look for another match at the same place and
        # Java does not. Blank matches do not count, so ask for one that leaves less text behind it than before it.
        return f"(?{flags})(?=([\\s\\S]*))(?:{java_body(pattern, 1)})(?!\\1\\z)"
    return f"(?{flags})" + java_body(pattern)


_TOKEN = re.compile(r"\(\?P[<=]\w+[>)]|\\.|[^\\]", re.DOTALL)


def lower_case(pattern: str) -> str | None:
    """The case-blind pattern as an exact one for lower-case text, where that is the same; else nothing.

    Java finds exact text many times faster, skipping ahead by the length of the word a pattern begins with.
    """
    if not _folds(_sre.parse(pattern, re.IGNORECASE)):
        return None
    out = []
    for token in _TOKEN.findall(pattern.removeprefix("(?i)")):
        if token.startswith("\\"):
            if token[1] in "xuUN0123456789":
                return None
            out.append(token)
        elif token.startswith("(?P"):
            out.append(token)
        elif ord(token) < 128:
            out.append(token.lower())
        else:
            return None
    return "".join(out)


def _folds(item) -> bool:
    """Whether no part is sensitive to case or spans letters together with other characters."""
    if isinstance(item, (list, tuple, _sre.SubPattern)):
        parts = list(item)
        name = str(parts[0]) if parts else ""
        if name == "RANGE":
            low, high = parts[1]
            ends = chr(low) + chr(high)
            letters = any(chr(c).isalpha() for c in range(low, min(high, 127) + 1))
            return high < 128 and (not letters or (ends.isalpha() and ends.islower() == ends[0].islower()))
        if name == "SUBPATTERN" and parts[1][2] & re.IGNORECASE:
            return False
        return all(_folds(part) for part in parts)
    return True


_CODE_POINT = re.compile(r"\\(?:(0[0-7]{0,2}|[1-3][0-7]{2})|U([0-9A-Fa-f]{8})|(v))")


def _code_point(pattern: str, i: int) -> tuple[str, int] | None:
    """An escape that names one character otherwise than Java does, and the index after it."""
    found = _CODE_POINT.match(pattern, i)
    if not found:
        return None
    octal, long, _ = found.groups()
    code = int(octal, 8) if octal else int(long, 16) if long else 0x0B
    return f"\\x{{{code:x}}}", found.end()


def java_body(pattern: str, groups_before: int = 0) -> str:
    out, names, groups = [], {}, groups_before
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if point := _code_point(pattern, i):
            out.append(point[0])
            i = point[1]
        elif c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e in "swd":
                out.append(f"[{_CLASSES[e]}]")
            elif e in "SWD":
                out.append(f"[^{_CLASSES[e.lower()]}]")
            elif e == "b":
                out.append(_BOUNDARY)
            elif e == "B":
                out.append(_NOT_BOUNDARY)
            elif e == "Z":
                out.append(r"\z")
            elif e in "123456789":
                number = re.compile(r"\d\d?").match(pattern, i + 1).group()
                out.append(f"(?:\\{int(number) + groups_before})")
                i += len(number) - 1
            else:
                out.append(c + e)
            i += 2
        elif c == "[":
            text, i = _java_class(pattern, i)
            out.append(text)
        elif c == "(":
            named = re.compile(r"\(\?P<(\w+)>").match(pattern, i)
            again = re.compile(r"\(\?P=(\w+)\)").match(pattern, i)
            if named:
                groups += 1
                names[named.group(1)] = groups
                out.append("(")
                i = named.end()
            elif again:
                out.append(f"(?:\\{names[again.group(1)]})")
                i = again.end()
            else:
                groups += pattern[i + 1 : i + 2] != "?"
                out.append(c)
                i += 1
        elif c == "{":
            count = re.compile(r"\{(\d*)(,?)(\d*)\}").match(pattern, i)
            if count and (count.group(1) or (count.group(2) and count.group(3))):
                out.append("{" + (count.group(1) or "0") + count.group(2) + count.group(3) + "}")
                i = count.end()
            else:
                out.append(r"\{")
                i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _java_class(pattern: str, start: int) -> tuple[str, int]:
    """Rewrite the character class that opens at ``start``; returns its text and the index after it."""
    anything = re.compile(r"\[(?:\\s\\S|\\S\\s|\\w\\W|\\W\\w|\\d\\D|\\D\\d)\]").match(pattern, start)
    if anything:
        return anything.group(), anything.end()
    i = start + 1
    negated = pattern.startswith("^", i)
    i += negated
    out = ["[^" if negated else "["]
    first = True
    while first or pattern[i] != "]":
        c = pattern[i]
        if point := _code_point(pattern, i):
            out.append(point[0])
            i = point[1]
        elif c == "\\":
            e = pattern[i + 1]
            if e in "swd":
                out.append(_CLASSES[e])
            elif e in "SWD" and not negated:
                out.append(f"[^{_CLASSES[e.lower()]}]")
            elif e == "b":
                out.append(r"\x08")
            else:
                out.append(c + e)
            i += 2
        else:
            out.append("\\" + c if c in "[]&" else c)
            i += 1
        first = False
    return "".join(out) + "]", i + 1


def required_text(pattern: str) -> list[tuple[str, ...]]:
    """Lower-case ASCII texts a match must contain: every tuple must have one of its members present."""
    needs = [n for n in _needs(_sre.parse(pattern, re.IGNORECASE)) if n]
    strong = [n for n in needs if min(map(len, n)) > 1] or needs
    return sorted(dict.fromkeys(strong), key=lambda n: (len(n), -min(map(len, n))))


def choose_gates(needs: list[list[tuple[str, ...]]]) -> list[tuple[str, ...]]:
    """For each pattern, given what it requires, texts one of which must be present; few texts serve all patterns.

    A text is stood for by the shortest text it contains ("execute" by "exec"), and patterns prefer texts that
    are looked for anyway. A pattern that requires nothing has an empty gate.
    """
    texts_needed = {t for need in needs for texts in need for t in texts}
    known = {t for t in texts_needed if len(t) >= GATE_LENGTH}

    def shortest_within(text: str) -> str:
        for n in range(GATE_LENGTH, len(text)):
            if found := known.intersection(text[i:i + n] for i in range(len(text) - n + 1)):
                return min(found)
        return text

    root = {t: shortest_within(t) for t in texts_needed}
    options = [[tuple(dict.fromkeys(root[t] for t in texts)) for texts in need] for need in needs]
    uses: dict[str, int] = {}
    for choices in options:
        for t in {t for texts in choices for t in texts}:
            uses[t] = uses.get(t, 0) + 1
    chosen: set[str] = set()
    gates: list[tuple[str, ...]] = [()] * len(needs)
    for i in sorted(range(len(needs)), key=lambda i: (len(options[i]), i)):
        if options[i]:
            gates[i] = min(options[i], key=lambda texts: (
                min(map(len, texts)) < GATE_LENGTH, len(set(texts) - chosen), -sum(uses[t] for t in texts), len(texts)))
            chosen.update(gates[i])
    return gates


def _needs(parsed) -> list[tuple[str, ...]]:
    """Walk a parsed regex; ``run`` holds the texts that may stand at the current place, all of them spelled out.

    ``tail`` is the part of them after the last choice: one text to look for where ``run`` has several.
    """
    needs: list[tuple[str, ...]] = []
    run: tuple[str, ...] = ("",)
    tail = ""

    def close():
        nonlocal run, tail
        if all(run):
            needs.append(run)
        if len(run) > 1 and len(tail) >= GATE_LENGTH:
            needs.append((tail,))
        run, tail = ("",), ""

    def extend(texts: list[str]):
        nonlocal run, tail
        if len(run) * len(texts) > MAX_SPELLINGS:
            close()
        elif len(texts) > 1 and min(map(len, run)) >= GATE_LENGTH:
            needs.append(run)  # fewer texts to look for, though less telling
        run = tuple(dict.fromkeys(r + t for r in run for t in texts))
        tail = tail + texts[0] if len(texts) == 1 else ""

    def walk(items):
        for op, arg in items:
            name = str(op)
            if name == "SUBPATTERN":
                walk(arg[-1])
            elif name == "AT":
                continue
            elif (texts := _spelled(name, arg)) is not None:
                extend(texts)
            else:
                close()
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                    needs.extend(_needs(arg[2]))
                elif name == "ATOMIC_GROUP":
                    needs.extend(_needs(arg))
                elif name == "BRANCH":
                    needs.append(_any_branch(arg[1]))

    walk(parsed)
    close()
    return needs


def _spelled(name: str, arg) -> list[str] | None:
    """All texts an item stands for, if they are few and plain."""
    if name == "LITERAL":
        return [chr(arg).lower()] if arg < 128 else None
    if name == "IN" and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
        return sorted({chr(a).lower() for _, a in arg}) if len(arg) <= MAX_SPELLINGS else None
    if name == "BRANCH" and len(arg[1]) <= MAX_SPELLINGS:
        texts = []
        for branch in arg[1]:
            parts = [_spelled(str(o), a) for o, a in branch]
            if any(p is None or len(p) != 1 for p in parts):
                return None
            texts.append("".join(p[0] for p in parts))
        return texts
    return None


def _any_branch(branches) -> tuple[str, ...]:
    """One required text per branch, or nothing when some branch needs none."""
    picked = []
    for branch in branches:
        single = [n for n in _needs(branch) if n]
        if not single:
            return ()
        picked.extend(max(single, key=lambda n: (min(map(len, n)) >= GATE_LENGTH, -len(n), min(map(len, n)))))
    return tuple(dict.fromkeys(picked))
