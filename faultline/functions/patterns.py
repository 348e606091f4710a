"""What a regular expression needs: fixed texts of which one must be in any text that it matches; and the same expression for RE2."""

from __future__ import annotations

import re
from re import _constants as K, _parser

#: Escapes that stand for one character of a kind, or for none.
KINDS = set("dDwWsSbBAzZGhHvVRtnrfae")


class Unknown(Exception):
    """The pattern uses something that is not looked into."""


class _Reader:
    """Reads a pattern from left to right. `any_of` returns texts of which one is needed, or none if nothing is."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self, n: int = 1) -> str:
        if self.i + n > len(self.p):
            raise Unknown
        self.i += n
        return self.p[self.i - n : self.i]

    def least_times(self) -> int | None:
        """The fewest repeats of what was just read; None where no quantifier stands."""
        c = self.peek()
        if c and c in "?*+":
            self.take()
            least = int(c == "+")
        elif c == "{":
            end = self.p.find("}", self.i)
            first = self.p[self.i + 1 : end].split(",")[0] if end > 0 else ""
            if not first.isdigit():
                raise Unknown
            self.i, least = end + 1, int(first)
        else:
            return None
        if self.peek() and self.peek() in "?+":  # lazy or possessive
            self.take()
        return least

    def skip_class(self) -> None:
        if self.peek() == "^":
            self.take()
        if self.peek() == "]":
            raise Unknown
        while (c := self.take()) != "]":
            if c == "\\":
                self.take()
            elif c == "[" or (c == "&" and self.peek() == "&"):
                raise Unknown

    def group(self) -> list[str]:
        if self.peek() != "?":
            return self.any_of(True)
        self.take()
        kind = self.take()
        if kind == ":" or kind == ">":
            return self.any_of(True)
        if kind in "=!" or (kind == "<" and self.peek() and self.peek() in "=!"):  # a look around binds no text of its own
            if kind == "<":
                self.take()
            self.any_of(True)
            return []
        if kind == "<":
            while self.take() != ">":
                pass
            return self.any_of(True)
        raise Unknown  # flags in the middle

    def any_of(self, inside: bool) -> list[str]:
        branches = [self.branch()]
        while self.peek() == "|":
            self.take()
            branches.append(self.branch())
        if inside and self.take() != ")":
            raise Unknown
        return [] if any(not b for b in branches) else [t for b in branches for t in b]

    def branch(self) -> list[str]:
        needs, run = [], ""
        while self.peek() and self.peek() not in "|)":
            c = self.take()
            char, texts = None, []
            if c == "(":
                texts = self.group()
            elif c == "[":
                self.skip_class()
            elif c == "\\":
                e = self.take()
                if not e.isalnum():
                    char = e
                elif e in "pP" and self.peek() == "{":
                    while self.take() != "}":
                        pass
                elif e not in KINDS:
                    raise Unknown
            elif c not in ".^$":
                char = c
            least = self.least_times()
            if char is not None and least is None:
                run += char
                continue
            if char is not None and least:
                run += char
            needs.append([run] if run else [])
            run = ""
            if texts and least != 0:
                needs.append(texts)
        needs.append([run] if run else [])
        return max(needs, key=lambda t: (min(map(len, t), default=0), -len(t)))


def required_text(pattern: str) -> list[str] | None:
    """Lower-case texts of which one must be in a line for the pattern to be found; None if unknown.

    Nested or joined classes, flags other than a leading (?i), references and code points are not looked into.
    Texts of fewer than three characters say too little, but for signs outside ASCII.
    """
    try:
        reader = _Reader(pattern.removeprefix("(?i)"))
        texts = reader.any_of(False)
        if reader.i < len(reader.p) or not texts:
            return None
    except Unknown:
        return None
    if min(map(len, texts)) < 3 and pattern.isascii():
        return None
    return [t.lower() for t in texts]


# ---- the same pattern for RE2 -----------------------------------------------------------------

_KINDS = {K.CATEGORY_DIGIT: "0-9", K.CATEGORY_WORD: "0-9A-Za-z_", K.CATEGORY_SPACE: r"\t\n\x0b\f\r "}
_NO_KINDS = dict(zip((K.CATEGORY_NOT_DIGIT, K.CATEGORY_NOT_WORD, K.CATEGORY_NOT_SPACE), _KINDS.values()))
#: What ends a line for Java, but for the line feed.
_ENDS = r"\r\x{85}\x{2028}\x{2029}"


def _letters(low: int, high: int, folded: bool) -> str:
    """Members of a class; without regard to case that is for Java the letters of ASCII alone."""
    out = [(low, high)]
    for a, z, shift in ((65, 90, 32), (97, 122, -32)) if folded else ():
        if max(low, a) <= min(high, z):
            out.append((max(low, a) + shift, min(high, z) + shift))
    return "".join(rf"\x{{{x:x}}}" if x == y else rf"\x{{{x:x}}}-\x{{{y:x}}}" for x, y in out)


class _Writer:
    """Writes a parsed pattern for RE2. `plain_only` is set if it stands for Java's in plain texts alone."""

    plain_only = False

    def members(self, items: list, folded: bool) -> str:
        negated = items[0][0] is K.NEGATE
        rest = items[1:] if negated else items
        if not negated and len(rest) == 1 and rest[0][0] is K.CATEGORY and rest[0][1] in _NO_KINDS:
            return f"[^{_NO_KINDS[rest[0][1]]}]"
        out = ""
        for op, arg in rest:
            if op is K.LITERAL:
                out += _letters(arg, arg, folded)
            elif op is K.RANGE:
                out += _letters(*arg, folded)
            elif op is K.CATEGORY and arg in _KINDS:
                out += _KINDS[arg]
            else:
                raise Unknown
        return f"[{'^' if negated else ''}{out}]"

    def sequence(self, items: list, folded: bool, last: bool) -> str:
        out = ""
        for i, (op, arg) in enumerate(items):
            ends = last and i == len(items) - 1
            if op is K.LITERAL:
                out += f"[{_letters(arg, arg, folded)}]"
            elif op is K.NOT_LITERAL:
                out += f"[^{_letters(arg, arg, folded)}]"
            elif op is K.ANY:
                out += rf"[^\n{_ENDS}]"
            elif op is K.IN:
                out += self.members(arg, folded)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                least, most, body = arg
                times = {(0, 1): "?", (0, K.MAXREPEAT): "*", (1, K.MAXREPEAT): "+"}.get((least, most))
                if times is None and (least > 99 or (most is not K.MAXREPEAT and most > 99)):
                    raise Unknown
                out += f"(?:{self.sequence(list(body), folded, False)})" + (times or f"{{{least},{'' if most is K.MAXREPEAT else most}}}")
            elif op is K.SUBPATTERN and not arg[1] and not arg[2]:
                out += f"(?:{self.sequence(list(arg[3]), folded, ends)})"
            elif op is K.BRANCH:
                out += "(?:" + "|".join(self.sequence(list(b), folded, ends) for b in arg[1]) + ")"
            elif op is K.AT and arg is K.AT_BEGINNING:
                out += r"\A"
            elif op is K.AT and arg is K.AT_END and ends:
                out, self.plain_only = out + r"\r?\z", True
            elif op is K.AT and arg in (K.AT_BOUNDARY, K.AT_NON_BOUNDARY):
                out, self.plain_only = out + (r"\b" if arg is K.AT_BOUNDARY else r"\B"), True
            else:
                raise Unknown
        return out


def re2_form(pattern: str, ignore_case: bool = False) -> tuple[str, bool] | None:
    """The pattern as RE2 text that is found in a text just where Java finds the pattern, and whether that holds for plain texts
    (ASCII, without a line feed) alone; None if it is not known. Kinds of characters and cases of letters are spelled out, as the two differ in them."""
    body = pattern.removeprefix("(?i)")
    # letters after a backslash that both read alike; nested or joined classes, possessive repeats and other flags are not looked into
    if re.search(r"\\[^\W_](?<![dDwWsSbBtnrf])|\[\^?\]|&&|[*+?}]\+|\(\?(?!:)", body):
        return None
    try:
        reader, writer = _Reader(body), _Writer()
        reader.any_of(False)
        tree = _parser.parse(body)
        if reader.i < len(body) or tree.state.flags & ~re.UNICODE:
            return None
        return f"(?:{writer.sequence(list(tree), ignore_case or body != pattern, True)})", writer.plain_only
    except (Unknown, re.error):
        return None
